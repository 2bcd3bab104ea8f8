import pytest
from pyspark.sql import functions as F

from pagesift.plans.rules import Rule, checked_pattern, java_pattern, parse_rules, route, route_rules, split_rule

ROUTES = [
    # rule, key, kind on HTML, kind on JSON
    ("title: //title/text()", "title", "xpath", "json_regex"),
    ("//title/text()", "//title/text()", "key_regex", "json_key"),
    ("x: h1", "x", "regex", "json_regex"),
    ("price: .cls", "price", "regex", "json_regex"),
    ("x: div > p", "x", "css", "json_regex"),
    (r"x: \$[0-9]+", "x", "css", "json_regex"),
    (r"x: (\d+)", "x", "xpath", "json_regex"),
    ("x: $.a.b[0]", "x", "css", "json_path"),
    ("x: $[0].id", "x", "css", "json_regex"),
    ("x:", "x", "key_regex", "json_key"),
    (": y", "rule_3", "invalid", "invalid"),
    (r"https?://\S+", "https?", "xpath", "json_regex"),
    ("//a/following-sibling::p", "//a/following-sibling", "regex", "json_regex"),
    ("$.user-agent", "$.user-agent", "key_regex", "json_key"),
    ("x: .//a", "x", "xpath", "json_regex"),
]


@pytest.mark.parametrize(("text", "key", "html", "js"), ROUTES)
def test_route(text, key, html, js):
    rule = split_rule(text, 3)
    assert (rule.key, route(rule, False), route(rule, True)) == (key, html, js)


def test_route_of_a_table_is_the_same(spark):
    rows = [(k, t, j) for k, (t, *_) in enumerate(ROUTES) for j in (True, False)]
    df = spark.createDataFrame(rows, "k int, rule string, is_json boolean").withColumn("rule_idx", F.lit(3))
    for r in route_rules(df).collect():
        text, key, html, js = ROUTES[r.k]
        assert (r.key, r.kind) == (key, js if r.is_json else html), text
        assert r.expr == split_rule(text, 3).expr or r.kind == "invalid"


def test_rules_of_a_text_and_a_list_are_the_same():
    text = "a: //h1\n\n  b: x  \r\na: //h2"
    want = [Rule("a", "//h2", None, 1), Rule("b", "x", None, 2)]
    assert parse_rules(text) == want == parse_rules(["a: //h1", " ", "b: x", "a: //h2"])


def test_pattern_dialect(spark):
    assert java_pattern(r"(?P<a>x)(?P=a)\Z") == r"(?Ud)(?<a>x)\k<a>\z"
    assert java_pattern(r"a{,3}\(?P<") == r"(?Ud)a{0,3}\(?P<"
    assert checked_pattern(spark, r"(a)(b)").groups == 2
    for bad in ("(", "[z-a]"):
        with pytest.raises(ValueError):
            checked_pattern(spark, bad)
