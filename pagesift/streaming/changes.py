"""Captures of a stream that say something new, and outcome counts kept up with a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagesift.operators.extract import extract

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Columns of microseconds beside those of the table.
CAPTURED, ARRIVED = "captured in us", "arrived in us"


class Changes(StatefulProcessor):
    """Of one url's captures those whose content isn't that of the newest one so far.

    What the newest capture said is kept for ``days`` after the url was last
    seen; then it is forgotten, and the next capture passes whatever it says.
    """

    def __init__(self, days: float, names: list[str]):
        self.lifetime, self.names = int(days * 86_400_000), names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "digest long, captured long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.newest.get() if self.newest.exists() else None
        digest, at = (known[0], known[1]) if known else (None, None)
        # of one url and batch, in the order of arrival
        ordered = sorted(rows, key=lambda r: (r[ARRIVED], r[CAPTURED] is not None, r[CAPTURED] or 0))
        for r in ordered:
            late = at is not None and r[CAPTURED] is not None and r[CAPTURED] < at
            if digest is not None and r.digest == digest:
                at = at if late else r[CAPTURED]
                continue
            yield Row(**{n: r[n] for n in self.names})
            if not late:  # one that comes late says what was, not what is
                digest, at = r.digest, r[CAPTURED]
        self.newest.update((digest, at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ordered[-1][ARRIVED] // 1000 + self.lifetime)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def changed_captures(captures: DataFrame, days: float = 30, delay: str = "1 hour", keep: tuple[str, ...] = ("page_id", "captured_at")) -> DataFrame:
    """A stream of ``url``, the columns of ``keep`` and ``digest`` of captures that say something new of their url.

    ``captures`` has ``url``, ``html``, ``captured_at`` and ``arrived_at``.  A
    capture with the content of the url's newest one is skipped.  Time is that
    of arrival, so a capture that is late by its own time is no late row and
    passes if it says something else; the newest one stays the newest.  Html
    itself doesn't go through the state.  What a batch has of one url is put in
    the order of arrival in memory.  Captures without ``arrived_at`` are left
    out, as no time tells when to forget them.  The session's state store has to be
    RocksDB.  Captures without a url are those of one url.
    """
    names = ["url", *keep, "digest"]
    rows = captures.where("arrived_at IS NOT NULL").withWatermark("arrived_at", delay).select(F.coalesce("url", F.lit("")).alias("key"), "url", *keep, *({"arrived_at"} - set(keep)), F.unix_micros("captured_at").alias(CAPTURED), F.unix_micros("arrived_at").alias(ARRIVED), F.xxhash64("html").alias("digest"))
    out = T.StructType([rows.schema[n] for n in names])
    return rows.groupBy("key").transformWithState(Changes(days, names), outputStructType=out, outputMode="append", timeMode="eventTime")


def count_outcomes(pages: DataFrame, rules, out: str, checkpoint: str, delay: str = "2 days", id_col: str = "page_id") -> StreamingQuery:
    """Keep up counts of results by day of capture, rule and outcome; ``pages`` is a stream with ``captured_at``.

    Every batch writes the counts that it changed to a folder of its own; one
    that is run again after a failure writes the same folder again.  Days older
    than the watermark are closed.
    """
    named = pages.select(F.struct(F.col(id_col).alias("id"), "captured_at").alias("of"), "url", "html")
    rows = extract(named, rules, id_col="of").select(F.col("page_id.captured_at").alias("captured_at"), "key", "status")
    counts = rows.withWatermark("captured_at", delay).groupBy(F.window("captured_at", "1 day").alias("w"), "key", "status").agg(F.count(F.lit(1)).alias("n"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.select(F.col("w.start").alias("day"), "key", "status", "n").write.mode("overwrite").parquet(f"{out}/batch={batch:06d}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes_so_far(spark: SparkSession, out: str) -> DataFrame:
    """``day``, ``key``, ``status`` and ``n`` as the last batch that changed them says."""
    rows = spark.read.schema("day timestamp, key string, status string, n long, batch int").parquet(out)
    return rows.groupBy("day", "key", "status").agg(F.max_by("n", "batch").alias("n"))
