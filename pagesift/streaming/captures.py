"""Extraction as captures arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagesift.operators.extract import extract
from pagesift.sources.captures import PAGES


def page_stream(spark: SparkSession, path: str, schema=PAGES, files_per_batch: int = 1000) -> DataFrame:
    """New files under a path; a path that is a single file is read too, for which it is given as a pattern."""
    if not any(c in path for c in "*?[{"):
        path = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def extract_stream(pages: DataFrame, rules, out: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Append the long results of new captures to ``out``.

    With ``once`` all captures that the checkpoint doesn't know yet are taken
    and the query ends, as a scheduled run needs; else it goes on.
    """
    writer = extract(pages, rules, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").option("path", out).start()


def without_repeats(pages: DataFrame, within: str = "1 day") -> DataFrame:
    """A stream without captures of a url that came within ``within`` of one before; later ones than the watermark go."""
    return pages.withWatermark("captured_at", within).dropDuplicatesWithinWatermark(["url"])
