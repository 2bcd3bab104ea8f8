import json

import pytest
from pyspark.sql import functions as F

from pagesift import queries
from pagesift.functions import paths
from pagesift.functions.htmltree import parse
from pagesift.functions.nodes import node_rows, page_nodes
from pagesift.functions.paths import PATH, PathError, css, xpath


known = {}


def found(spark, kind, expr, page):
    """What a path shows on a page; all paths of the lists below are run at once, as rows."""
    if (kind, expr, page) not in known:
        asked = [(kind, expr, page)]
        if page == GOOD:
            asked += [("xpath", x, GOOD) for x, _ in XPATHS] + [("css", x, GOOD) for x, _ in SELECTORS]
        elif page == LISTS:
            asked += [("xpath", x, LISTS) for x, _ in PLACES]
        rows = [(*key, json.dumps((xpath if key[0] == "xpath" else css)(key[1]).path)) for key in dict.fromkeys(asked)]
        df = spark.createDataFrame(rows, "kind string, expr string, page string, path string").select("kind", "expr", "page", page_nodes(F.col("page")).alias("nodes"), F.from_json("path", PATH).alias("path"))
        places = paths.found(F.col("nodes"), F.col("path"))
        for r in df.select("kind", "expr", "page", F.transform(places, lambda f: paths.shown(F.col("nodes"), F.col("path"), f)).alias("shown")).collect():
            known[r.kind, r.expr, r.page] = r.shown
    return known[kind, expr, page]


GOOD = """<html><head><title>T &amp; t</title><meta name="description" content="about"/></head><body>
<h2>two</h2><div class="a b"><h1>one</h1><p id="p1">x<b>y</b>z</p><p>q</p></div><h3>three</h3>
<a href="/1">l1</a><img src="/i.png" alt="i"/><a href="/2">l2</a>
<table><tr><th>h</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table></body></html>"""


XPATHS = [
    ("//title/text()", ["T & t"]),
    ("//h1 | //h2 | //h3", ["two", "one", "three"]),
    ("//a/@href", ["/1", "/2"]),
    ("//img/@alt | //img/@src", ["i", "/i.png"]),
    ('//meta[@name="description"]/@content', ["about"]),
    ("//p", ["xyz", "q"]),
    ("//p/text()", ["x", "z", "q"]),
    ("//div[contains(@class,'b')]/p[2]", ["q"]),
    ("(//p)[last()]", ["q"]),
    ("//p[@id]/b/..", ["xyz"]),
    ("//tr[td]/td[1]/text()", ["1", "3"]),
    ("//table//th/text()", ["h"]),
    ("//p[text()='q']", ["q"]),
    ("//p[not(@id) and starts-with(., 'q')]", ["q"]),
    ("//zzz", []),
    ("/html/body/h2", ["two"]),
    ("//div/*", ["one", "xyz", "q"]),
    (".//title", ["T & t"]),
    ("//*[@class]//b", ["y"]),
    ("//table//tr//td/text()", ["1", "2", "3"]),
    ("(//p)[2]", ["q"]),
    ("//a[@href!='/1']", ["l2"]),
]


@pytest.mark.parametrize(("path", "want"), XPATHS)
def test_xpath(spark, path, want):
    assert found(spark, "xpath", path, GOOD) == want


SELECTORS = [
    ("h1", ["one"]),
    (".a.b > p", ["xyz", "q"]),
    ("#p1", ["xyz"]),
    ("#p1 + p", ["q"]),
    ("h1 ~ p", ["xyz", "q"]),
    ("a[href='/2'], h2", ["two", "l2"]),
    ("[class~=a] b", ["y"]),
    ("a[href^='/'][href$='1']", ["l1"]),
    ("p:first-child", []),
    ("p:last-child", ["q"]),
    ("td:nth-child(2)", ["2"]),
    ("*[alt*=i]", [""]),
]


@pytest.mark.parametrize(("selector", "want"), SELECTORS)
def test_css(spark, selector, want):
    assert found(spark, "css", selector, GOOD) == want


@pytest.mark.parametrize("bad", ["//", "//a[", "//a[@x=]", "foo::a", "//a[bar()]", "(\\d+)", "//\\S+", "//a]", "string(//h1)", "//h1/following-sibling::p", "//a/@*", "//a | "])
def test_bad_xpath(spark, bad):
    with pytest.raises(PathError):
        xpath(bad)


@pytest.mark.parametrize("bad", ["", "> p", "a >", "\\$[0-9]+", "a::before", "div p:hover"])
def test_bad_css(spark, bad):
    with pytest.raises(PathError):
        css(bad)


def test_tag_soup(spark):
    page = 'a</i><p><b>one<p>two<ul><li>x<li>y</ul>&copy;<script>"</p><a href=1>"</script><br>end<td>t<td>u'
    for path, want in (("//p", ["one", "two"]), ("//li", ["x", "y"]), ("//a", []), ("//td", ["t", "u"])):
        assert found(spark, "xpath", path, page) == want
    assert parse(page).text() == 'aonetwoxy©"</p><a href=1>"endtu'
    assert parse("").children == [] and parse("<").text() == "<" and parse("<!-- x").text() == ""


def test_references_that_are_cut():
    """A name needs its semicolon, but for ``&amp``; a parameter of a url isn't a reference."""
    for text, want in {"&quot": "&quot", "&quot;": '"', "&copy": "&copy", "&copy;&middot;": "©·", "&amp": "&", "&ampx;": "&x;", "&amp;quot;": "&quot;", "&am": "&am", "&": "&", "&#233;&#xe9": "éé", "&nosuch;": "&nosuch;", "&notin;&notit;": "∉&notit;", "&&amp;&": "&&&"}.items():
        for tag in ("title", "h1"):
            assert parse(f"<{tag}>{text}</{tag}>").text() == want
    assert parse('<a href="?a=1&copy=2&amp;quot=3&amp=4">').children[0].attrs == {"href": "?a=1&copy=2&quot=3&=4"}


@pytest.mark.parametrize("query", ["preset", "xpath_title", "xpath_heading", "xpath_union"])
def test_cut_titles_are_as_in_the_sql(spark, tmp_path, query):
    text = "Or onwhea token = &quot"
    spark.createDataFrame([(1, "http://h/1", f"<html><title>{text}</title><body><h1>{text}</h1>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = queries.QUERIES[query](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[query]})").fetchall())


def test_nodes():
    rows = node_rows(parse("<div a=1>x<p>y<b>z</b></p></div>w"))
    assert [(r[0], r[1], r[2], r[3], r[5]) for r in rows] == [(1, 6, 0, "div", None), (2, 2, 1, "#text", "x"), (3, 6, 1, "p", None), (4, 4, 3, "#text", "y"), (5, 6, 3, "b", None), (6, 6, 5, "#text", "z"), (7, 7, 0, "#text", "w")]
    assert rows[0][4] == [("a", "1")] and node_rows(parse("")) == []


def test_null_and_empty_pages_have_no_nodes(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "page string")
    assert [r[0] for r in df.select(F.size(page_nodes(F.col("page")))).collect()] == [None, 0, 1]


def test_forms_agree_with_the_built_in(spark):
    page = GOOD.replace("&amp;", "and")
    df = spark.createDataFrame([(page,)], "x string")
    for path in ("//title/text()", "//a/@href", "//p/text()", "//tr/td/text()", "//div[@class='a b']/h1/text()"):
        assert df.select(F.xpath("x", F.lit(path))).first()[0] == found(spark, "xpath", path, page), path
    for k in (1, 2):
        assert df.select(F.xpath_string("x", F.lit(f"(//p)[{k}]"))).first()[0] == found(spark, "xpath", f"(//p)[{k}]", page)[0]


LISTS = '<ul><li><a href="/1">a</a></li><b>x</b><li><a href="/2">b</a><li>c</ul><ul><li><a href="/3">d</a><li>e</ul>'
PLACES = [
    ("//ul/li[a][2]", ["b"]),  # the second of those with a link, not the second item
    ("//ul/li[a][last()]", ["b", "d"]),
    ("//li[last()]", ["c", "e"]),
    ("//ul/*[2]", ["x", "e"]),
    ("(//li | //b)[2]", ["x"]),
    ("(//ul/li)[1] | //b", ["a", "x"]),
    ("//li/a/@href | //b | //li/a/@href", ["/1", "x", "/2", "/3"]),
    ("//ul//a/text()", ["a", "b", "d"]),
    ("//li[0]", []),
    ("//li/a/../a", ["a", "b", "d"]),
    ("//li[not(a)]", ["c", "e"]),
]


@pytest.mark.parametrize(("path", "want"), PLACES)
def test_places_and_unions(spark, path, want):
    assert found(spark, "xpath", path, LISTS) == want


def test_only_what_rules_touch_leaves_the_helper():
    tree = parse(GOOD)
    rows = node_rows(tree, xpath("//title/text()").needs)
    assert [(r[3], r[5]) for r in rows] == [("title", None), ("#text", "T & t")] and rows[0][4] == []
    rows = node_rows(tree, xpath("//div/p[@id]").needs | css("a[href]").needs)
    assert [r[3] for r in rows] == ["div", "p", "#text", "#text", "#text", "p", "#text", "a", "#text", "a", "#text"]
    assert [r[2] for r in rows][:4] == [0 if rows[0][6] else -1, 1, 2, -1]  # a parent that isn't kept is none
    assert sum(len(str(r)) for r in node_rows(tree, xpath("//title/text()").needs)) * 20 < sum(len(str(r)) for r in node_rows(tree))


def test_what_is_left_out_changes_nothing(spark):
    """The same nodes are found among all nodes and among those that the path needs."""
    for kind, expr in (("xpath", "//div/p[2]"), ("xpath", "/html/body/h2"), ("xpath", "//div[h1]//b"), ("xpath", "//tr[td]/td[last()]/text()"), ("css", "h1 ~ p"), ("css", "#p1 + p"), ("css", "body p b"), ("xpath", "//p[text()='q']"), ("xpath", "//p/b/..")):
        path = (xpath if kind == "xpath" else css)(expr)
        df = spark.createDataFrame([(GOOD,)], "page string").select(page_nodes(F.col("page"), path.needs).alias("nodes"))
        assert df.select(F.transform(path.found(F.col("nodes")), lambda n: path.shown(F.col("nodes"), n))).first()[0] == found(spark, kind, expr, GOOD), expr  # noqa: B023


@pytest.mark.parametrize(("kind", "expr"), [("css", "nav > ul > li"), ("xpath", "//li/a[1]"), ("xpath", "//nav//li[a][1]"), ("css", "li ~ li"), ("xpath", "//div//div")])
def test_time_is_in_proportion_to_the_page(spark, kind, expr):
    import time

    took = {}
    for n in (500, 500, 4000):
        page = "<nav>" + "".join(f'<ul><li><a href="/{k}">x</a><li>y</ul>' for k in range(n)) + "</nav>" + "<div>" * (n // 2)
        began = time.time()
        found(spark, kind, expr, page)
        took[n] = time.time() - began
    assert took[4000] < 8 * took[500] + 3  # 160 kB; by pairs of nodes it would be 64 times as long
