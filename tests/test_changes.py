"""Streams that keep what captures said, counts of streams, sketches, layouts, stored responses."""

import datetime
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from pagesift.functions.nodes import Needs, page_nodes
from pagesift.operators import blocklist, outcomes
from pagesift.plans.rules import Rule
from pagesift.queries import responses
from pagesift.sources import captures as io
from pagesift.streaming import changes


@pytest.fixture
def rocks(spark):
    spark.conf.set(*changes.ROCKS)
    yield
    spark.conf.unset(changes.ROCKS[0])


def test_changes_lifetimes_and_late_captures(spark, rocks, tmp_path):
    schema = "url string, html string, captured int, arrived int, n int"
    batches = [
        [("u", "a", 10, 10, 1), ("u", "a", 20, 20, 2), ("v", "x", 10, 10, 3), (None, "z", 10, 10, 4), ("w", None, 10, 10, 5)],
        [("u", "b", 30, 30, 6), ("v", "x", 30, 30, 7), ("w", None, 30, 30, 8), ("lost", "q", 30, None, 9)],
        [("u", "old", 5, 40, 10), ("u", "b", 41, 41, 11)],  # late by its own time: passes, and the newest stays the newest
        [("other", "o", 9000, 9000, 12)],  # time goes on, and what v said is forgotten
        [("v", "x", 9001, 9001, 13), ("other", "o", 9002, 9002, 14)],
    ]
    for batch in batches:
        rows = spark.createDataFrame(batch, schema).select("url", "html", F.timestamp_seconds(F.col("captured") + 1_000_000).alias("captured_at"), F.timestamp_seconds(F.col("arrived") + 1_000_000).alias("arrived_at"), "n", F.lit("clash").alias("key"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = changes.changed_captures(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), days=1000 / 86400, delay="1 minute", keep=("n", "captured_at"))
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3, 4, 5, 6, 10, 12, 13]


def test_counts_of_a_stream_that_failed(spark, tmp_path, monkeypatch):
    day = lambda k: datetime.datetime(2024, 1, k)
    data = [[(1, "u", "<p>x", day(1)), (2, "u", "none", day(1))], [(3, "u", "<p>", day(1)), (4, "u", "<p><p>", day(2))], []]
    rules = [Rule("p", "<p>", "regex")]
    for k, batch in enumerate(data):
        df = spark.createDataFrame(batch, "page_id long, url string, html string, captured_at timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = lambda df=df: changes.count_outcomes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), rules, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        if k == 1:  # the batch is written, and then the run fails
            with monkeypatch.context() as m:
                write = changes.F.col
                m.setattr(changes.F, "col", lambda name: 1 / 0 if name == "w.start" else write(name))
                with pytest.raises(Exception, match="division"):
                    run()
        run()
    got = sorted(tuple(r) for r in changes.outcomes_so_far(spark, f"{tmp_path}/out").withColumn("day", F.dayofmonth("day")).collect())
    assert got == [(1, "p", "no_match", 1), (1, "p", "one", 2), (2, "p", "many", 1)]


def test_sketches(spark):
    found = spark.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 3000).cast("string"), F.lit("/track")).alias("resource_url"))
    one, two = (blocklist.blocked_sketches(x, patterns=["track", "none"]) for x in (found.where("page_id < 20000"), found.where("page_id >= 10000")))
    r = blocklist.sketch_counts(blocklist.merged_sketches(one.union(two))).collect()
    assert [(x.pattern, x.requests) for x in r] == [("track", 40_000)]
    assert abs(r[0].pages - 30_000) < 1500 and abs(r[0].hosts - 3000) < 150


def test_layouts(spark):
    """Estimates by sketches are near the similarity of the whole sets of parts."""
    page = lambda extra: "<html><body><h1>t</h1><ul><li><a>x</a></ul><article><p>y<b>z</b></article>" + extra + "</body></html>"
    rows = [(1, "http://same/a", page("")), (1, "http://more/a", page("")), (1, "http://new/a", page("")), (2, "http://same/b", page("") * 2), (2, "http://more/b", page("<i>q</i>")), (2, "http://new/b", "<table><tr><td><em>x"), (2, "http://gone/a", None), (1, "http://one/a", page(""))]
    df = spark.createDataFrame(rows, "run int, url string, html string")
    got = {r.host: r.similarity for r in outcomes.layout_changes(outcomes.layout_sketches(df, hashes=256), least=2).collect()}
    sets = {}
    for r in df.select("run", "url", page_nodes(F.col("html"), Needs(None)).alias("nodes")).select("run", "url", outcomes.layout_parts(F.col("nodes")).alias("parts")).where("parts IS NOT NULL").collect():
        sets[r.run, r.url.split("/")[2]] = set(r.parts)
    want = {h: len(sets[1, h] & sets[2, h]) / len(sets[1, h] | sets[2, h]) for h in ("same", "more", "new")}
    assert set(got) == set(want) and want["same"] == 1 and want["new"] == 0
    assert all(abs(got[h] - want[h]) < 0.12 for h in want)
    assert [r.host for r in outcomes.layout_changes(outcomes.layout_sketches(df)).collect()] == ["new"]


def test_responses(spark, tmp_path):
    body = "<p>é\r\n\r\nx"
    files = {
        "a": f"HTTP/1.1 200 OK\r\nX-Url: http://h/a\r\nContent-Length: {len(body.encode())}\r\nA: 1\r\na: 2:3\r\n\r\n{body}trailing".encode(),
        "b": b"HTTP/1.0 404 Not Found\nContent-Location: http://h/b\nContent-Length: many\n\n" + body.encode(),
        "c": b"no head at all",
        "d": b"",
        "e": b"HTTP/1.1 204 No Content\r\nX: y\r\n\r\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[1]: r for r in io.read_responses(spark, f"{tmp_path}/*").collect()}
    assert {k: (r.url, r.status, r.html) for k, r in got.items()} == {"a": ("http://h/a", 200, body), "b": ("http://h/b", 404, body), "c": (None, None, "no head at all"), "e": (None, 204, "")}
    assert got["a"].headers["a"] == "2:3" and got["c"].headers is None


def test_packed_responses(spark, tmp_path):
    """Responses in the rows of one file are read as files of one each are."""
    files = {"a": "HTTP/1.1 200 OK\r\nX-Url: http://h/a\r\nContent-Length: 4\r\nA: 1\r\na: 2:3\r\n\r\né\r\ntrailing".encode(), "b": b"HTTP/1.0 404 Not Found\nContent-Location: http://h/b\n\nx", "c": b"no head at all", "d": b""}
    (tmp_path / "one").mkdir()
    for name, data in files.items():
        (tmp_path / "one" / name).write_bytes(data)
    spark.createDataFrame([(name, bytearray(data)) for name, data in files.items()] + [("e", None)], io.STORED).coalesce(1).write.parquet(f"{tmp_path}/many")
    each, packed = io.read_responses(spark, f"{tmp_path}/one").collect(), io.read_responses(spark, f"{tmp_path}/many", "parquet").collect()
    assert {r.file: r[1:] for r in packed} == {r.file.rsplit("/", 1)[1]: r[1:] for r in each} and len(packed) == 3 and packed[0].html == "é\r\n"


def test_responses_do_not_take_a_file_each(spark, tmp_path):
    pages = [(k, f"http://h/{k}", f"<p>é{k}\r\n\r\n" * (k % 4)) for k in range(200)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    at = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/pagesift/responses-*"
    before = set(glob.glob(at))
    got = responses(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((u, 404 if k % 5 == 0 else 200, hashlib.sha256(h.encode()).hexdigest(), "text/html") for k, u, h in pages)
    (made,) = set(glob.glob(at)) - before
    assert len(glob.glob(f"{made}/**/part-*", recursive=True)) <= 3
