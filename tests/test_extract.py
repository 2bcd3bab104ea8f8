import json

import pytest
from pyspark.sql import functions as F

from pagesift.operators import blocklist, jobs, outcomes, shape
from pagesift.operators.extract import extract, extract_wide, with_results
from pagesift.plans.rules import Rule
from pagesift.sources import captures as io
from pagesift.streaming.captures import extract_stream, page_stream, without_repeats

TABLE = "<title>\n Tab \u00a0</title><table><tr><th>h</th></tr><tr>" + "".join(f"<td> {k} </td>" for k in range(12)) + "</tr></table>"
JSON = '{"a": {"b": [1, 2.0, {"c": "x"}]}, "n": null, "t": true, "s": "text", "u-v": "w", "d.e": 1.0, "many": [1, 2]}'


def rows(spark, text, rules, **kw):
    pages = spark.createDataFrame([(1, "http://h/x", text)], "page_id long, url string, html string")
    return {r.key: r for r in extract(pages, rules, **kw).collect()}


def test_cap_strip_and_shapes(spark):
    got = rows(spark, TABLE, ["t: //title/text()", "td: //td", "none: //zzz", r"bad: (\d+)", "css: \\$[0-9]+", "one: <title>[^<]*", ": y"])
    assert (got["t"].status, got["t"].value) == ("one", "Tab")
    td = got["td"]
    assert (td.status, td.n_matches, td["values"]) == ("many", 12, [str(k) for k in range(10)])
    assert (got["none"].status, got["none"].value, got["none"].n_matches) == ("no_data", "No data found", 0)
    assert got["bad"].error.startswith("XPath error: ") and got["css"].error.startswith("CSS selector error: ")
    assert got["one"].kind == "css"
    assert (got["rule_7"].status, got["rule_7"].error) == ("error", "Empty key name")


def test_regex_on_source(spark):
    got = rows(spark, "<b> x </b>&amp;<i>y</i>", [Rule("one", "> [a-z] <", "regex"), Rule("many", " ?[xy] ?", "regex"), Rule("two", "<(.)>( ?.)", "regex"), Rule("amp", "&amp;", "regex"), "&amp;", Rule("broken", "(", "regex")])
    assert got["one"].value == "> x <" and got["many"]["values"] == [" x ", "y"]
    assert [json.loads(v) for v in got["two"]["values"]] == [["b", " x"], ["i", "y"]]
    assert got["amp"].value == "&amp;" == got["&amp;"].value and got["&amp;"].kind == "key_regex"
    assert got["broken"].error.startswith("Extraction error: ")


def test_json(spark):
    rules = ["s", "n", "zzz", "u-v", "d.e", "many", "p: $.a.b[0]", "last: $.a.b[-1].c", "deep: $.a.b[2].c", "gone: $.a.x", "two: $.a.b[0][1]", "re: [0-9]", "none: z{3}", "groups: (a)(b)", "xp: //title"]
    got = rows(spark, JSON, rules)
    assert {k: got[k].value for k in ("s", "n", "u-v", "d.e", "many")} == {"s": "text", "n": "null", "u-v": "w", "d.e": "1.0", "many": "[1,2]"}
    assert got["zzz"].status == "no_data"
    assert (got["p"].value, got["last"].value, got["deep"].value) == ("1", "x", "x")
    assert got["gone"].error.startswith("JSON extraction error: ") and got["two"].error.startswith("JSON error: ")
    assert got["re"].value == "1, 2, 0, 1, 0, 1, 2" and got["none"].value == "No matches found"
    assert got["groups"].error.startswith("JSON extraction error: ")
    assert got["xp"].kind == "json_regex"
    assert rows(spark, "[1]", ["a"])["a"].error.startswith("JSON error: ")
    assert rows(spark, "5", ["a"])["a"].kind == "json_key"


def test_strictness(spark):
    for text, is_json in (('{"a":1}', True), ('{"a":1} x', False), (' [1, "]"] ', True), ("1", True), ("1,2", False), ("1],[2", False), ('"a"', True), ("nullx", False), ("null", True), ("[1", False), ('{"a":1}{"a":1}', False)):
        assert (rows(spark, text, ["a"])["a"].kind == "json_key") is is_json, text


def test_page_errors_and_extra_columns(spark):
    data = [(1, "u", "<p>x", 200, "requests"), (2, "u", "<p>x", 404, "requests"), (3, "u", "<p>x", 500, "playwright"), (4, None, "", 200, None), (5, "u", None, None, None), (6, "u", " \n", 200, "x"), (7, "u", "[1]", 200, "playwright")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, status int, mode string").withColumn("results", F.lit(1)).withColumn("key", F.lit("clash"))
    got = {(r.page_id, r.key): r for r in extract(pages, ["a: //p", "b: zzz"], mode_col="mode", status_col="status").collect()}
    assert len(got) == 14
    errors = {p: got[p, "a"].page_error for p in range(1, 8)}
    assert errors == {1: None, 2: "Request failed: status 404", 3: None, 4: "No content retrieved", 5: "No content retrieved", 6: "HTML parsing failed: no markup or text", 7: None}
    assert got[7, "a"].kind == "xpath" and got[2, "a"].error == errors[2]
    assert extract(pages.limit(0), ["a: //p"]).count() == 0
    assert extract(pages, []).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k}<p>{'<a>x' * (k % 15)}") for k in range(200)], "page_id long, url string, html string")
    rules = ["p: //p", "a: //a", "r: x"]
    one, many = (sorted(map(tuple, extract(pages.repartition(n), rules).collect()), key=str) for n in (1, 7))
    assert one == many and len(one) == 600
    assert all(len(r[7]) <= 10 and r[6] >= len(r[7]) for r in one)


def test_wide_and_report(spark):
    pages = spark.createDataFrame([(1, "u", '<h1>a"b</h1><p>x<p>y'), (2, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: json.loads(r.result) for r in extract_wide(pages, ["h: //h1", "p: //p", "z: //z"]).collect()}
    assert got == {1: {"h": 'a"b', "p": ["x", "y"], "z": "No data found"}, 2: {"error": "No content retrieved"}}
    text = {r.page_id: r.report for r in shape.reports(with_results(pages, ["h: //h1", "p: //p"])).collect()}
    assert text == {1: '✅ h: a"b\n📋 p:\n  1. x\n  2. y', 2: "❌ Error: No content retrieved"}


def test_jobs(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(
        "\n".join(json.dumps(x) for x in [{"job_id": 1, "url": "u1", "rules": "h: //h1\n\n zz "}, {"job_id": 2, "url": "u1", "rules": ["h: //h1", "n: $.a"], "mode": "playwright"}, {"job_id": 3, "url": "", "rules": "x"}, {"job_id": 4, "url": "u9", "rules": "x"}, {"job_id": 5, "url": "u2", "rules": "n: $.a"}])
    )
    pages = spark.createDataFrame([("u1", "<h1>A</h1>"), ("u2", '{"a": [1]}')], "url string, html string")
    read = io.read_jobs(spark, str(tmp_path / "jobs.json"))
    got = {r.job_id: (r.job_error, json.loads(r.result)) for r in jobs.run_jobs(read, pages).collect()}
    assert got[1] == (None, {"h": "A", "zz": "No matches found"})
    assert got[2][1]["h"] == "A" and got[3][0] == "No URL provided" and got[4][0].startswith("Request failed")
    assert got[5] == (None, {"n": "[1]"})
    assert [r.job_id for r in jobs.without_capture(read, pages).orderBy("job_id").collect()] == [3, 4]


def test_blocklist(spark):
    pages = spark.createDataFrame([(1, "https://h.example/d/p?q", '<script src="/a/track.js"></script><img src="i.png"><iframe src="//cdn/x"><link href="https://o/y">')], "page_id long, url string, html string")
    found = {r.resource_url: r.blocked for r in blocklist.block_requests(blocklist.resource_requests(pages), "resource_url").collect()}
    assert found == {"https://h.example/a/track.js": True, "https://h.example/d/i.png": False, "https://cdn/x": False, "https://o/y": False}
    listed = spark.createDataFrame([("cdn",)], "pattern string")
    assert blocklist.block_requests(blocklist.resource_requests(pages), "resource_url", listed).where("blocked").count() == 1


def test_latest_and_changes(spark):
    caps = spark.createDataFrame([("u", 1, 10), ("u", 2, 10), ("u", 3, 5), ("v", 4, 1)], "url string, page_id long, captured_at long")
    assert sorted(r.page_id for r in outcomes.latest_captures(caps).collect()) == [2, 4]
    odd = spark.createDataFrame([(None, 1, 1, "a"), (None, 1, 2, "b"), ("u", 5, 5, "c"), ("u", 5, 5, "d"), ("u", 5, 5, "d"), ("v", None, None, "e")], "url string, page_id long, captured_at long, html string")
    assert sorted((str(r.url), r.html) for r in outcomes.latest_captures(odd).collect())[0] == ("None", "b") and outcomes.latest_captures(odd).count() == 3
    rates = spark.createDataFrame([(1, "h", "k", 1.0), (2, "h", "k", 0.2), (3, "h", "k", 0.1)], "run int, host string, key string, rate double")
    assert [r.run for r in outcomes.structure_changes(rates).collect()] == [2]


def test_sinks_and_sources(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>x<p>y")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages")
    back = io.read_pages(spark, f"{tmp_path}/pages")
    io.write_json(extract_wide(back, ["p: //p"]), f"{tmp_path}/json")
    io.write_csv(extract(back, ["p: //p"]), f"{tmp_path}/csv")
    io.write_xml(extract(back, ["p: //p"]), f"{tmp_path}/xml")
    io.write_reports(shape.reports(with_results(back, ["p: //p"])), f"{tmp_path}/text")
    assert spark.read.json(f"{tmp_path}/json").first().p == ["x", "y"]
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/csv").first()["values"] == "x\ny"
    assert spark.read.format("xml").option("rowTag", "result").load(f"{tmp_path}/xml").first().key == "p"
    (tmp_path / "one.html").write_text("<h1>a\nb</h1>")
    assert io.read_pages(spark, f"{tmp_path}/one.html", "text").first().html == "<h1>a\nb</h1>"


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k}") for k in range(40)], "page_id long, url string, html string")
    pages.repartition(4).write.parquet(f"{tmp_path}/in")
    run = lambda: extract_stream(page_stream(spark, f"{tmp_path}/in", files_per_batch=1), ["p: //p"], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    pages.limit(1).withColumn("page_id", F.lit(99).cast("long")).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # takes what is new only
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("page_id", "value").collect()))
    assert got == sorted([(k, str(k)) for k in range(40)] + [(99, got[-1][1])])


def test_repeats_in_a_stream(spark, tmp_path):
    """A url that came within the time before isn't taken again; rows later than the watermark go."""
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    for batch in ([("u", 0), ("u", 10), ("v", 0)], [("u", 40), ("w", 30)], [("x", 9000)], [("u", 9001), ("late", 1)]):
        rows = spark.createDataFrame(batch, "url string, s int").select("url", F.timestamp_seconds(F.col("s") + 1_000_000).alias("captured_at"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = without_repeats(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 minute")
        stream.writeStream.outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u", "u", "v", "w", "x"]


def test_a_long_blocklist_is_joined(spark, monkeypatch):
    monkeypatch.setattr(blocklist, "MOST_PATTERNS", 3)
    urls = spark.createDataFrame([("http://a/track7x",), ("http://a/track7x",), ("http://a/ok",), (None,)], "url string").withColumn("found", F.lit(1))
    listed = spark.createDataFrame([(f"track{k}",) for k in range(10)] + [(None,)], "pattern string")
    got = blocklist.block_requests(urls, "url", listed).collect()
    assert sorted((str(r.url), r.blocked) for r in got) == [("None", False), ("http://a/ok", False), ("http://a/track7x", True), ("http://a/track7x", True)]


@pytest.mark.parametrize("text", ["<" * 3000, "<p" * 500, "<div>" * 3000, '<a "' * 300])
def test_hostile_pages(spark, text):
    got = rows(spark, text, ["p: //p", "c: div > p"])
    assert got["p"].status in ("one", "many", "no_data")
