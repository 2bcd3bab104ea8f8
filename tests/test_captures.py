"""Newest captures and long blocklists: results, and plans that hold at scale."""

import random

from pyspark.sql import functions as F

from pagesift.operators import blocklist
from pagesift.operators.outcomes import latest_captures


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latest_captures(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", "c", None]), f"<p>{k}" * 50, r.choice([None, 1, 2, 3])) for k in range(60)]
    rows += [(99, "a", "<i>", 9), (99, "a", "<b>", 9), (100, "twice", "<p>", 1), (100, "twice", "<p>", 1), (None, "null", "<p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at int").withColumn("tag", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = latest_captures(df, ("at", "page_id")).collect()
    want = {}
    for i, u, h, at in rows:
        key = (-1 if at is None else at, -1 if i is None else i)
        want.setdefault(u, []).append((key, h))
    assert len(got) == len(want) and got[0].asDict().keys() == set(df.columns)
    for x in got:
        best = max(k for k, _ in want[x.url])
        assert ((-1 if x["at"] is None else x["at"], -1 if x.page_id is None else x.page_id), x.html) in [y for y in want[x.url] if y[0] == best]
    assert latest_captures(df.limit(0), ("at",)).count() == 0


def test_whole_rows_are_never_sorted(spark):
    """Urls and keys alone are grouped; html takes part in no aggregate (but for rows that are equal in full) and no sort."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "u", "<p>", 1)], "page_id long, url string, html string, at int")
        found = latest_captures(df, ("at", "page_id"))
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in physical and "SortAggregate" not in physical.split("Union")[0] and "ShuffledHashJoin" in physical
        assert found.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_blocklist(spark, monkeypatch):
    monkeypatch.setattr(blocklist, "MOST_PATTERNS", 20)
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abc/.é%_") for _ in range(k))
    urls = [None, "", "a", *(f"http://{word(30)}" for _ in range(300))]
    urls += urls[:40]
    for patterns in ([word(r.choice((1, 2, 4, 5, 6, 9))) for _ in range(40)] + [None] + ["http://x"] * 3, [word(7) for _ in range(400)] + [u[5:20] for u in urls[50:60]], [*(word(9) for _ in range(30)), ""]):
        listed = spark.createDataFrame([(p,) for p in patterns], "pattern string").withColumn("hit", F.lit("clash"))
        df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").withColumn("gram", F.lit("clash"))
        found = blocklist.block_requests(df, "u", listed)
        got = {x.k: x.blocked for x in found.collect()}
        assert got == {k: u is not None and any(p is not None and p in u for p in patterns) for k, u in enumerate(urls)}
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Join Inner, true" not in plan(found)
