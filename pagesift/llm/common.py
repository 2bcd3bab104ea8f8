"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8-byte ids that may be broadcast: 2 million ids are about 50 MB as a
#: hash relation.  Larger sets take the shuffled form of the same join.
BROADCAST_IDS = 2_000_000

#: A key is hot if more than one in so many rows has it; so there are at most so many hot keys.
HOT_SHARE = 2_000
HOT_ROWS = 100

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of texts that go to a Python worker at once, unless the session has a setting of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


_kept: dict = {}


def kept(name: Hashable, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing at a time, as a worker outlives its stage."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Drop what a stage before left in this worker; helpers that keep nothing begin with it.

    A task that has ended may hold it in a cycle of references, which Python
    wouldn't look for soon among so many objects that live long.
    """
    if _kept:
        import gc

        import pyarrow as pa

        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is.

    For a text of ASCII alone ``lower`` does the same and is much faster.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bounded_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches bounded in bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` of ``docs``, and more columns between them, to be handed to Python workers.

    Texts go there in batches bounded in bytes, which is a setting of the
    session: rows alone would bound nothing where texts are long.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), *more, F.col(text_col).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    It is set here only where it is unset and Spark runs in one process (tests).
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagesift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/pagesift/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path, which knows every store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Give a whole folder its final name, in one step."""
    fs, at = file_system(spark, path)
    end = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(end.getParent())
    if not fs.rename(at, end):
        raise OSError(f"can't move {path} to {to}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table survives lost executors, unlike a cached or local copy.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Mark a table of narrow rows for broadcast if it has at most ``limit`` rows.

    ``ids`` should be a written table, so that the count costs next to nothing.
    """
    return F.broadcast(ids) if is_small(ids, limit) else ids


def is_small(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def fits(df: DataFrame, rows: int, size: Column, most_bytes: int) -> bool:
    """Whether a table has at most so many rows, and so many bytes in the column that may be long."""
    if not is_small(df, rows):
        return False
    return (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes


def drop_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` isn't in ``ids``; rows with a null key stay."""
    return docs.join(small_enough(ids.select(key).distinct()), key, "left_anti")


def keep_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids``."""
    return docs.join(small_enough(ids.select(key).distinct()), key, "left_semi")


def hot_keys(side: DataFrame, count: str) -> DataFrame:
    """The rows of ``side`` whose key has more than its share of all rows; at most ``HOT_SHARE`` at any size."""
    total = side.agg(F.sum(count)).first()[0] or 0
    return side.where(F.col(count) > max(HOT_ROWS, total / HOT_SHARE))


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of many ``rows`` with ``side``, which has a key once and in ``count`` how many rows have it.

    The rows of hot keys stay where they are: their part of ``side``, which is
    at most ``HOT_SHARE`` rows at any size, is broadcast.  All others are joined
    by shuffling.  Both tables should be written ones.
    """
    hot = hot_keys(side, count)
    if hot.isEmpty():
        return rows.join(side, keys)
    others = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(side, keys)
    return others.unionByName(rows.join(F.broadcast(hot), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
