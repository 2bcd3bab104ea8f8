"""Stored long results in other forms: objects, reports, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.text import value_mark


def last_of_key(results: DataFrame, page_col: str = "page_id") -> DataFrame:
    """Of stored rows with one page and key the last counts, at the place of the first."""
    keep = [c for c in results.columns if c not in (page_col, "key", "rule_idx")]
    last = F.max_by(F.struct(*keep), "rule_idx").alias("last")
    return results.groupBy(page_col, "key").agg(F.min("rule_idx").alias("rule_idx"), last).select(page_col, "key", "rule_idx", "last.*")


def result_objects(results: DataFrame, page_col: str = "page_id") -> DataFrame:
    """One map of key and value per page, from stored long rows."""
    rows = last_of_key(results.select(page_col, "key", "rule_idx", "value"), page_col)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rule_idx", "key", "value"))), lambda x: F.struct(x["key"], x["value"]))
    return rows.groupBy(page_col).agg(F.map_from_entries(pairs).alias("result"))


def positions(results: DataFrame) -> DataFrame:
    """One row per kept value, with its place in the list from 1."""
    return results.select("page_id", "url", "rule_idx", "key", F.posexplode("values").alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def first_matches(matches: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of stored matches (``page_id``, ``key``, ``pos``) of each page and key."""
    place = F.row_number().over(W.partitionBy("page_id", "key").orderBy("pos"))
    return matches.withColumn("place", place).where(F.col("place") <= n)


def marks(results: DataFrame) -> DataFrame:
    """Adds ``mark``: how a report shows a value."""
    return results.withColumn("mark", value_mark(F.col("key"), F.col("value"), F.col("status") == "many"))


def report_line(r: Column) -> Column:
    """A report's lines for one result: a list under its key, or a marked value."""
    items = F.transform(r["values"], lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    bad = F.lower(r["value"]).contains("error")
    one = F.concat(F.when(bad, "❌ ").otherwise("✅ "), r["key"], F.lit(": "), F.coalesce(r["value"], F.lit("null")))
    many = F.concat_ws("\n", F.concat(F.lit("📋 "), r["key"], F.lit(":")), F.concat_ws("\n", items))
    return F.when((r["status"] == "many") & (r["kind"] != "json_regex"), many).otherwise(one)


def reports(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``report`` from pages with ``results`` and ``page_error``, within each row."""
    body = F.array_join(F.transform("results", report_line), "\n")
    text = F.when(F.col("page_error").isNotNull(), F.concat(F.lit("❌ Error: "), F.col("page_error"))).when(F.size("results") == 0, "No data extracted").otherwise(body)
    return pages.select("page_id", "url", text.alias("report"))
