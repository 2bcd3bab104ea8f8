"""Exact deduplication by a stream with keyed state.

Normalised texts are stored as they arrive, each run in a folder of its own, and
their digests are taken in as a stream.  A streaming aggregation keeps, for every
digest ever seen, the row that stays, where its content lies and how many rows
there were; its state lives on disk (RocksDB) and never expires, so a later run
with the same state goes on where the last one ended.  Where a digest has got
more rows since its texts were last compared, the full bytes of all of them, of
earlier runs too, are read back from the files that they lie in and compared.

A run is named by what it takes in, and its folder appears when all of it is
written.  So a run that stopped at any point is done again by calling it again:
what is stored already isn't stored twice, and the stream goes on where it was.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, exists, is_small, join_hot, keep_ids, lower_ascii, moved, scratch_path, small_enough, table, written

#: Digest bytes that one micro-batch takes in, and digests that may be broadcast.
BYTES_PER_BATCH = 16 << 30
BROADCAST_DIGESTS = 300_000
#: Files that are read by name; if texts lie in more of them, all are looked through.
NAMED_FILES = 10_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # state that is small for its number of partitions would else claim disk ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a task closes its part of the state when it ends, and all open ones share bounded memory
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
}
CONTENTS = "doc_id {kind}, digest string, full string, n_bytes long, run long, row long, content string"


def normal(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


@contextmanager
def disk_state(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_name(docs: DataFrame, id_col: str, text_col: str) -> int:
    """A name for a table's ids and texts, whatever their order: sums of two hashes of its rows, and their number."""
    h = [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)) for k in (1, 2)]
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h[0]).alias("x"), F.sum(F.pmod(h[1], F.lit(1 << 31))).alias("y"))
    return n.select(F.xxhash64("n", "x", "y")).first()[0]


def store(docs: DataFrame, state_path: str, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64) -> int:
    """Store the normalised texts of ``docs`` as a run, whose number is returned; if it is stored already, nothing is done.

    A row is named by ``run`` and ``row``, whose upper bits are the number of
    the file that it lies in; so these two are its locator.
    """
    spark, run = docs.sparkSession, run_name(docs, id_col, text_col)
    at = run_path(state_path, run)
    if exists(spark, at):
        return run
    text = normal(text_col)
    full = F.sha2(text, 256)
    part = f"{state_path}/incoming/run-{run}"
    docs.select(
        F.col(id_col).alias("doc_id"),
        F.substring(full, 1, digest_chars).alias("digest"),
        full.alias("full"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(run).cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("content"),
    ).write.mode("overwrite").parquet(part)
    moved(spark, part, at)
    return run


def run_path(state_path: str, run: int) -> str:
    return f"{state_path}/contents/run-{run}"


def contents_at(spark: SparkSession, state_path: str, places: DataFrame, kind: str) -> DataFrame:
    """The stored rows in the files that ``places`` (``run``, ``row``) lead to."""
    files = places.select("run", F.shiftright("row", 33).alias("part")).distinct()
    at = [f"{state_path}/contents/*"]
    if is_small(files, NAMED_FILES):
        at = [f"{run_path(state_path, r.run)}/part-{r.part:05d}-*" for r in files.collect()] or at
    return spark.read.schema(CONTENTS.format(kind=kind)).parquet(*at)


def stream_index(stream: DataFrame) -> DataFrame:
    """The keyed state: per digest and length the row that stays, with its locator, and the number of rows."""
    keep = F.max(F.struct("doc_id", "run", "row")).alias("keep")
    return stream.groupBy("digest", "n_bytes").agg(keep, F.count(F.lit(1)).alias("group_size"))


def run_index(spark: SparkSession, state_path: str, kind: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Take in what is new among the stored contents and return the index after it; ``kind`` is the type of ids.

    Every micro-batch writes the keys it touched to a folder of its own, which a
    batch that is run again after a failure overwrites.
    """
    out = f"{state_path}/index"

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch:06d}")

    stream = spark.readStream.schema(CONTENTS.format(kind=kind)).option("maxBytesPerTrigger", bytes_per_batch).option("maxFileAge", "36500d").parquet(f"{state_path}/contents/*")
    index = stream_index(stream)
    with disk_state(spark):
        index.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(f"digest string, n_bytes long, keep struct<doc_id: {kind}, run: bigint, row: bigint>, group_size long, batch int").parquet(out)
    newest = F.max_by(F.struct("keep", "group_size"), "batch").alias("x")
    return found.groupBy("digest", "n_bytes").agg(newest).select("digest", "n_bytes", "x.*")


def collisions(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of ``hits`` whose texts aren't all the same bytes.

    The least and the greatest text of a digest are first found within each
    partition, so a group of any size moves two texts per partition at most.
    """
    own = texts.select("digest", "content").join(small_enough(hits, BROADCAST_DIGESTS), "digest", "left_semi")
    return own.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a != b").select("digest")


def compare_hits(spark: SparkSession, state_path: str, rows: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """All digests that have stood for several texts so far; those that got rows since they were compared are compared now.

    What is compared is noted with the number of its rows, so hits of a run that
    stopped before this are compared by whichever run comes next.
    """
    done_at, wrong_at = f"{state_path}/compared", f"{state_path}/collisions"
    todo = index.where("group_size > 1").select("digest", "n_bytes", "group_size")
    if exists(spark, done_at):
        todo = todo.join(spark.read.schema(todo.schema).parquet(done_at), todo.columns, "left_anti")
    todo = written(todo, "hits")
    if not todo.isEmpty():
        hits = written(todo.select("digest").distinct(), "digests")
        places = rows.select("digest", "run", "row").join(small_enough(hits, BROADCAST_DIGESTS), "digest", "left_semi")
        collisions(contents_at(spark, state_path, places, kind), hits).write.mode("append").parquet(wrong_at)
        todo.write.mode("append").parquet(done_at)
    return spark.read.schema("digest string").parquet(wrong_at).distinct() if exists(spark, wrong_at) else todo.select("digest").limit(0)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, state_path: str | None = None, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Groups of texts that are equal but for the case of A-Z.

    One row per row of ``docs``, and of those that earlier calls with the same
    ``state_path`` took in: ``doc_id``, ``keep_id`` (the largest id of the
    group), ``group_size``, ``kept``, ``text_sha256`` of the normalised text,
    and ``run`` and ``row``, which name the row, with ``keep_run`` and
    ``keep_row`` for the one that stays.  A null text is an empty one.  Of rows
    that repeat an id and a text the last one is kept; a null id is less than
    any other.  Other columns are ignored.  An empty table gives no rows.

    A call with the ids and texts of an earlier one adds nothing, so a call that
    failed can be made again, whatever it got done.
    """
    spark = docs.sparkSession
    state_path = state_path or scratch_path(spark, "dedup")
    kind = docs.schema[id_col].dataType.simpleString()
    store(docs, state_path, id_col, text_col, digest_chars)
    contents = spark.read.schema(CONTENTS.format(kind=kind)).parquet(f"{state_path}/contents/*")
    rows = contents.drop("content")
    if rows.isEmpty():
        index = rows.select("digest", "n_bytes", F.struct("doc_id", "run", "row").alias("keep"), F.lit(1).cast("long").alias("group_size"))
        out = rows.join(index, ["digest", "n_bytes"])
    else:
        index = written(run_index(spark, state_path, kind, bytes_per_batch), "index")
        wrong = compare_hits(spark, state_path, rows, index, kind)
        out = join_hot(rows, index, ["digest", "n_bytes"], "group_size")
        if not wrong.isEmpty():  # one digest for several texts: these are grouped by their whole text
            texts = contents.join(small_enough(wrong, BROADCAST_DIGESTS), "digest", "left_semi")
            exact = texts.groupBy("content").agg(F.max(F.struct("doc_id", "run", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
            apart = texts.join(exact, "content").select(out.columns)
            out = out.join(small_enough(wrong, BROADCAST_DIGESTS), "digest", "left_anti").unionByName(apart)
    kept = (F.col("run") == F.col("keep.run")) & (F.col("row") == F.col("keep.row"))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("full").alias("text_sha256"), "run", "row", F.col("keep.run").alias("keep_run"), F.col("keep.row").alias("keep_row"))


def content_at(spark: SparkSession, state_path: str, places: DataFrame) -> DataFrame:
    """The stored texts that ``places`` (``run``, ``row``) lead to, ``content``; only the files that these name are read."""
    places = written(places.select("run", "row").distinct(), "places")
    return contents_at(spark, state_path, places, "string").select("run", "row", "content").join(small_enough(places), ["run", "row"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without an id stay, as nothing can name them.  Of rows that repeat an
    id, with texts that are equal but for case, the one with the least text
    stays, and of equal texts the one whose columns are least as JSON.
    """
    found = written(exact_groups(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "kept"), "groups")
    gone, stay = found.where("NOT kept").select(id_col), found.where("kept").select(id_col)
    clean = drop_ids(docs, gone.join(stay, id_col, "left_anti"), id_col)
    twice = written(gone.join(stay, id_col, "left_semi").distinct(), "twice")
    if twice.isEmpty():
        return clean
    row, order = F.struct(*(F.col(c) for c in docs.columns)), F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.to_json(F.struct(*(F.col(c) for c in docs.columns))).alias("row"))
    least = F.min_by(row, order).alias("least")
    again = keep_ids(clean, twice, id_col).groupBy(F.col(id_col).alias("of"), F.sha2(normal(text_col), 256).alias("same")).agg(least).select("least.*")
    return drop_ids(clean, twice, id_col).unionByName(again)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("run", "row", "keep_run", "keep_row")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
