"""Counts and rates over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.nodes import Needs, page_nodes
from pagesift.functions.text import host

#: Hashes of a layout's sketch: a similarity is told to within 0.06, two thirds of the time.
HASHES = 64


def outcome_report(results: DataFrame, by: tuple[str, ...] = ("key", "status"), totals: bool = False) -> DataFrame:
    """How many results each rule had by outcome; with ``totals`` also by every leading part of ``by``."""
    grouped = results.rollup(*by) if totals else results.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def success_rate(results: DataFrame) -> DataFrame:
    """Per host: pages' results, those with data, and their share."""
    ok = F.col("status").isin("one", "many")
    return results.groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("n_ok"), F.avg(ok.cast("double")).alias("rate"))


def latest_captures(captures: DataFrame, keys: tuple[str, ...] = ("captured_at", "page_id")) -> DataFrame:
    """The newest capture of each url, one row for each; captures without a url are one group.

    Captures with equal keys are told apart by a hash of all their columns; of
    rows that are equal in all columns one is given.  Which capture is newest is
    found on urls, keys and hashes alone; whole rows are only fetched by these,
    without a sort or an aggregate.  A null key is older than any other.
    """
    tag = F.xxhash64(*captures.columns)
    mark = {k: f"newest {k}" for k in ("url", *keys, "tag", "n")}
    narrow = captures.select(F.col("url").alias(mark["url"]), *(F.col(k).alias(mark[k]) for k in keys), tag.alias(mark["tag"]))
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias(mark["n"]))
    order = F.struct(*(F.col(mark[k]) for k in keys), F.col(mark["tag"]), F.col(mark["n"]))
    newest = counted.groupBy(mark["url"]).agg(F.max(order).alias("x")).select(mark["url"], "x.*")

    def rows(of: DataFrame) -> DataFrame:
        same = [captures["url"].eqNullSafe(F.col(mark["url"])), tag == F.col(mark["tag"]), *(captures[k].eqNullSafe(F.col(mark[k])) for k in keys)]
        return captures.join(of.hint("shuffle_hash"), same, "left_semi")

    once, repeated = rows(newest.where(F.col(mark["n"]) == 1)), rows(newest.where(F.col(mark["n"]) > 1))
    return once.unionByName(repeated.dropDuplicates())


def hit_rates(results: DataFrame, run_col: str = "run") -> DataFrame:
    """Share of pages with data per run, host and key."""
    ok = F.col("status").isin("one", "many").cast("double")
    return results.groupBy(F.col(run_col).alias("run"), host(F.col("url")).alias("host"), "key").agg(F.avg(ok).alias("rate"))


def structure_changes(rates: DataFrame, drop: float = 0.5) -> DataFrame:
    """Runs in which a host's rule finds much less than in the run before."""
    before = F.lag("rate").over(W.partitionBy("host", "key").orderBy("run"))
    return rates.withColumn("before", before).where(F.col("before") - F.col("rate") >= drop)


def layout_parts(nodes: Column) -> Column:
    """What a page's layout is made of: names of elements with those of the two around them, each once."""
    name = lambda p: F.coalesce(F.get(nodes, p - 1)["tag"], F.lit(""))
    around = lambda n: F.coalesce(F.get(nodes, n["up"] - 1)["up"], F.lit(0))
    return F.array_distinct(F.transform(nodes, lambda n: F.concat_ws(">", name(around(n)), name(n["up"]), n["tag"])))


def layout_sketches(pages: DataFrame, run_col: str = "run", hashes: int = HASHES) -> DataFrame:
    """``run``, ``host`` and ``sketch``: the least of each of several hashes over all parts of the host's pages in a run.

    Sketches of parts of a run are merged by the least of each hash, and are of
    one size however many pages there are.  Pages without html have no layout.
    """
    found = pages.select(F.col(run_col).alias("run"), host(F.col("url")).alias("host"), page_nodes(F.col("html"), Needs(None)).alias("nodes"))
    parts = found.select("run", "host", F.explode(layout_parts(F.col("nodes"))).alias("part"))
    least = [F.min(F.xxhash64(F.lit(k), "part")).alias(f"h{k}") for k in range(hashes)]
    return parts.groupBy("run", "host").agg(*least).select("run", "host", F.array(*(f"h{k}" for k in range(hashes))).alias("sketch"))


def layout_changes(sketches: DataFrame, least: float = 0.6) -> DataFrame:
    """Runs in which a host's layout is unlike that of the run before: ``host``, ``run`` and ``similarity``, below ``least``.

    The similarity of two layouts is the share of equal hashes, which stands for
    what they have in common of all their parts.  It tells of a new layout
    before any rule fails.
    """
    before = F.lag("sketch").over(W.partitionBy("host").orderBy("run"))
    same = F.aggregate(F.zip_with("sketch", "before", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    return sketches.withColumn("before", before).where("before IS NOT NULL").select("host", "run", (same / F.size("sketch")).alias("similarity")).where(F.col("similarity") < least)
