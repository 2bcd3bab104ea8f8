"""Rules: their text, what kind of expression each is, and patterns that Spark can run."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.paths import PathError, css, xpath
from pagesift.functions.text import strip

KINDS = ("xpath", "css", "regex", "key_regex", "json_key", "json_path", "json_regex", "invalid")
CSS_SIGNS = "#[>~+"


@dataclass(frozen=True)
class Rule:
    """A rule; a given ``kind`` holds for pages of both types, else the expression's text decides."""

    key: str
    expr: str | None = None
    kind: str | None = None
    index: int = 0


def parse_rules(rules: str | list[str] | list[Rule]) -> list[Rule]:
    """Rules of a text block or a list, in order, blank ones left out, numbered from 1.

    Of rules with one key the last counts, at the place of the first.
    """
    lines = re.split(r"\r\n|[\n\v\f\r\x85\u2028\u2029]", rules) if isinstance(rules, str) else rules
    found = [x if isinstance(x, Rule) else x.strip() for x in lines]
    out: dict[str, Rule] = {}
    for i, x in enumerate((x for x in found if x), 1):
        r = replace(x, index=i) if isinstance(x, Rule) else split_rule(x, i)
        out[r.key] = replace(r, index=out[r.key].index) if r.key in out else r
    return list(out.values())


def split_rule(text: str, index: int) -> Rule:
    """Key and expression, cut at the first colon."""
    key, colon, expr = text.partition(":")
    key = key.strip()
    if not key and colon:
        return Rule(f"rule_{index}", None, "invalid", index)
    return Rule(key, expr.strip() or None, None, index)


def route(rule: Rule, is_json: bool) -> str:
    """The kind of a rule on a page of JSON or of HTML."""
    if rule.kind:
        return rule.kind
    e = rule.expr
    if is_json:
        return "json_key" if not e else "json_path" if e.startswith("$.") else "json_regex"
    if not e:
        return "key_regex"
    if e.startswith(("/", ".//", "(")):
        return "xpath"
    return "css" if any(c in e for c in CSS_SIGNS) else "regex"


def route_rules(rules: DataFrame, rule_col: str = "rule", index_col: str = "rule_idx", json_col: str = "is_json") -> DataFrame:
    """The same for a table of rules: adds ``key``, ``expr`` and ``kind``."""
    text = strip(F.col(rule_col))
    parts = F.split(text, ":", 2)
    key, rest = strip(parts[0]), F.when(F.size(parts) > 1, strip(F.element_at(parts, 2)))
    empty = (F.size(parts) > 1) & (key == "")
    expr = F.when(~empty & (rest != ""), rest)
    signs = [F.col("expr").contains(c) for c in CSS_SIGNS]
    any_sign = signs[0]
    for s in signs[1:]:
        any_sign = any_sign | s
    e = F.col("expr")
    kind = (
        F.when(empty, "invalid")
        .when(F.col(json_col) & e.isNull(), "json_key")
        .when(F.col(json_col) & e.startswith("$."), "json_path")
        .when(F.col(json_col), "json_regex")
        .when(e.isNull(), "key_regex")
        .when(e.startswith("/") | e.startswith(".//") | e.startswith("("), "xpath")
        .when(any_sign, "css")
        .otherwise("regex")
    )
    named = F.when(empty, F.concat(F.lit("rule_"), F.col(index_col).cast("string"))).otherwise(key)
    return rules.withColumn("expr", expr).withColumn("key", named).withColumn("kind", kind)


def java_pattern(pattern: str) -> str:
    """A pattern of Python's ``re`` as Java's; ``U`` gives Unicode classes, ``d`` lines that end at \\n only."""
    out, at = [], 0
    for m in re.finditer(r"\\.|\(\?P<|\(\?P=(\w+)\)|\{,(\d+)\}", pattern, re.DOTALL):
        out.append(pattern[at : m.start()])
        at = m.end()
        x = m[0]
        out.append({"\\Z": "\\z", "(?P<": "(?<"}.get(x) or (f"\\k<{m[1]}>" if m[1] else f"{{0,{m[2]}}}" if m[2] else x))
    return "(?Ud)" + "".join(out) + pattern[at:]


@dataclass(frozen=True)
class Pattern:
    java: str
    groups: int


def groups_of(pattern: str) -> int:
    """How many groups a pattern has; raises ``ValueError`` if Python doesn't take it."""
    try:
        return re.compile(pattern).groups
    except (re.error, OverflowError, RecursionError) as e:
        raise ValueError(str(e)) from e


def runs_here(java: Column) -> Column:
    """Whether the JVM takes a pattern."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java).isNotNull()


def checked_patterns(spark: SparkSession, patterns: list[str]) -> dict[str, Pattern | ValueError]:
    """Patterns that both Python and the JVM take, or what is wrong with them; one small job for all."""
    out: dict[str, Pattern | ValueError] = {}
    for p in patterns:
        try:
            out[p] = Pattern(java_pattern(p), groups_of(p))
        except ValueError as e:
            out[p] = e
    asked = [(p, x.java) for p, x in out.items() if isinstance(x, Pattern)]
    if asked:
        for r in spark.createDataFrame(asked, "pattern string, java string").where(~runs_here(F.col("java"))).collect():
            out[r.pattern] = ValueError(f"not supported here: {r.pattern}")
    return out


def checked_pattern(spark: SparkSession, pattern: str) -> Pattern:
    """The same for one pattern; raises ``ValueError``."""
    found = checked_patterns(spark, [pattern])[pattern]
    if isinstance(found, ValueError):
        raise found
    return found


def checked_path(kind: str, expr: str) -> str | None:
    """What is wrong with an XPath or a selector, or nothing."""
    try:
        (xpath if kind == "xpath" else css)(expr)
    except PathError as e:
        return ("XPath error: " if kind == "xpath" else "CSS selector error: ") + str(e)
    return None


#: The preset: title, heading, links, paragraphs and description of a page.
PRESET = """
title: //title/text()
heading: //h1/text()
links: //a/@href
paragraphs: //p/text()
meta_description: //meta[@name="description"]/@content
"""


def rule_lines(text: Column) -> Column:
    """The rules of a text block as an array: lines, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
