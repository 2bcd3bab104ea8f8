"""All rules on all pages in one pass: no join, no shuffle.

Rules of one set are known before the job, so they become expressions of two
projections: one that finds, with each rule's matches in a column of its own,
and one that shapes what is found.  Regular expressions and JSON paths are
Spark's own; XPath and CSS are steps over a page's nodes, which one vectorized
function lists once for all rules, leaving out what none of them can touch.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.nodes import Needs, page_nodes
from pagesift.functions.paths import css, found, literal, shown, xpath
from pagesift.functions.text import first_ten, strip
from pagesift.plans.rules import Pattern, Rule, checked_path, checked_patterns, parse_rules, route

CAP = 10
NO_DATA, NO_MATCH = "No data found", "No matches found"
RESULT = "struct<rule_idx:int,key:string,kind:string,status:string,n_matches:int,values:array<string>,value:string,error:string>"
#: Stands behind a page's text where it is read as part of a list, which tells whether anything follows its value.
END = "\u0001end of page\u0001"


def none() -> Column:
    return F.array().cast("array<string>")


def text_of(x: Column | str | None) -> Column:
    return F.lit(x).cast("string")


def result(rule: Rule, kind: Column | str, status: Column, n: Column, values: Column, value: Column, error: Column) -> Column:
    """What a rule gives; its index, key and kind may be columns."""
    return F.struct(
        F.lit(rule.index).alias("rule_idx"), text_of(rule.key).alias("key"), text_of(kind).alias("kind"), status.alias("status"), n.cast("int").alias("n_matches"), values.alias("values"), value.alias("value"), error.alias("error")
    ).cast(RESULT)


def failed(rule: Rule, kind: Column | str, error: Column | str) -> Column:
    return result(rule, kind, F.lit("error"), F.lit(0), none(), text_of(error), text_of(error))


def many_status(n: Column, nothing: str) -> Column:
    return F.when(n == 0, nothing).when(n == 1, "one").otherwise("many")


def shaped(rule: Rule, kind: str, n: Column, values: Column, nothing: str, sentinel: str) -> Column:
    """Nothing, one value or a list of at most ten."""
    value = F.when(n == 0, sentinel).when(n == 1, F.element_at(values, 1)).otherwise(F.to_json(values))
    return result(rule, kind, many_status(n, nothing), n, values, value, F.lit(None).cast("string"))


def dom_found(nodes: Column, path: Column) -> Column:
    """Of the nodes that an XPath or a selector finds the number, and the first ten as text, stripped."""
    counted = F.transform(F.array(found(nodes, path)), lambda x: F.struct(F.size(x).alias("n"), F.transform(F.slice(x, 1, CAP), lambda f: strip(shown(nodes, path, f))).alias("values")))
    return counted[0]


def matches(text: Column, p: Pattern) -> Column:
    """All matches as strings; of a pattern with groups, the group, or a JSON list of them if there are more."""
    if p.groups < 2:
        return F.regexp_extract_all(text, F.lit(p.java), F.lit(p.groups))
    each = [F.regexp_extract_all(text, F.lit(p.java), F.lit(g)) for g in range(1, p.groups + 1)]
    return F.transform(F.arrays_zip(*each), lambda z: F.to_json(F.array(*(z[str(k)] for k in range(p.groups)))))


def regex_result(rule: Rule, kind: str, found: Column) -> Column:
    """Matches in the page's source; a single one is stripped, of many the first ten are kept as they are."""
    n = F.size(found)
    kept = F.when(n == 1, F.transform(found, strip)).otherwise(first_ten(found))
    return shaped(rule, kind, n, kept, "no_match", NO_MATCH)


def quoted(name: str) -> str | None:
    """A path to a key of whatever name, for JSON functions; none where they can't take it."""
    return None if "'" in name or "]" in name else f"['{name}']"


def json_key_at(path: Column, text: Column, variant: Column) -> Column:
    """The value at a key of the top object, as JSON text; a null is a value, a missing key isn't."""
    at = F.try_variant_get(variant, path, "variant")
    value = F.when(F.is_variant_null(at), "null").otherwise(F.call_function("get_json_object", text, path))
    is_object = F.try_variant_get(variant, "$", "map<string,variant>").isNotNull()
    return F.struct(is_object.alias("object"), at.isNotNull().alias("there"), F.when(at.isNotNull(), value).otherwise(NO_DATA).alias("value"))


def json_key_found(name: str, text: Column, variant: Column) -> Column:
    step = quoted(name)
    if step is None:
        raise ValueError("unsupported key")
    return json_key_at(F.lit(f"${step}"), text, variant)


def json_key_result(rule: Rule, found: Column) -> Column:
    there, value = found["there"], found["value"]
    values = F.when(there, F.array(value)).otherwise(none())
    good = result(rule, "json_key", F.when(there, "one").otherwise("no_data"), there.cast("int"), values, value, F.lit(None).cast("string"))
    return F.when(found["object"], good).otherwise(failed(rule, "json_key", "JSON error: the page isn't an object"))


_STEP = re.compile(r"([^\[\]]*)(?:\[(-?\d+)\])?")


def json_steps(expr: str) -> list[tuple[str, int | None]]:
    """``$.a.b[0].c``: keys by dots, at most one index each, which may count from the end."""
    steps: list[tuple[str, int | None]] = []
    for part in expr[2:].split("."):
        m = _STEP.fullmatch(part)
        if not m or not m[1] or quoted(m[1]) is None:
            raise ValueError(f"unsupported step {part}")
        steps.append((m[1], int(m[2]) if m[2] else None))
    return steps


def json_path_at(steps: Column, text: Column, variant: Column) -> Column:
    """What lies at the end of a path: an array of ``name`` and ``index``."""

    def on(at: Column, s: Column) -> Column:
        named = F.try_variant_get(at, F.concat(F.lit("$['"), s["name"], F.lit("']")), "variant")
        listed = F.try_variant_get(named, "$", "array<variant>")
        return F.when(s["index"].isNull(), named).otherwise(F.try_element_at(listed, F.when(s["index"] < 0, s["index"]).otherwise(s["index"] + 1)))

    at = F.aggregate(steps, variant, on)
    plain = F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.concat(F.lit("['"), s["name"], F.lit("']"), F.when(s["index"].isNotNull(), F.concat(F.lit("["), s["index"].cast("string"), F.lit("]"))).otherwise(""))), ""))
    # text of numbers as the page has it, unless the path counts from the end
    from_end = F.coalesce(F.try_variant_get(at, "$", "string"), F.to_json(at))
    shown = F.when(F.exists(steps, lambda s: F.coalesce(s["index"] < 0, F.lit(False))), from_end).otherwise(F.call_function("get_json_object", text, plain))
    return F.struct(at.isNotNull().alias("there"), F.when(F.is_variant_null(at), "null").otherwise(shown).alias("value"))


def json_path_found(expr: str, text: Column, variant: Column) -> Column:
    each = [F.struct(F.lit(n).alias("name"), F.lit(k).cast("int").alias("index")) for n, k in json_steps(expr)]
    return json_path_at(F.array(*each), text, variant)


def json_path_result(rule: Rule, found: Column) -> Column:
    good = result(rule, "json_path", F.lit("one"), F.lit(1), F.array(found["value"]), found["value"], F.lit(None).cast("string"))
    return F.when(found["there"], good).otherwise(failed(rule, "json_path", F.concat(F.lit("JSON extraction error: nothing at "), text_of(rule.expr))))


def json_regex_result(rule: Rule, found: Column) -> Column:
    """All matches in the JSON text, joined; neither capped nor stripped."""
    n = F.size(found)
    value = F.when(n == 0, NO_MATCH).otherwise(F.array_join(found, ", "))
    return result(rule, "json_regex", many_status(n, "no_match"), n, found, value, F.lit(None).cast("string"))


def page_error(text: Column, mode: Column, status: Column) -> Column:
    """Why a page can't be used, or null."""
    blank = ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    return (
        F.when((mode != "playwright") & status.between(400, 599), F.concat(F.lit("Request failed: status "), status.cast("string")))
        .when(text.isNull() | (text == ""), "No content retrieved")
        .when(blank, "HTML parsing failed: no markup or text")
    )


def whole_json(text: Column, parsed: Column) -> Column:
    """Whether a text is one JSON value and nothing else; what follows a value is else passed over when it is parsed."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]'.replace("\u0001", "\\u0001")))), "$", "array<variant>")
    ends = (F.size(listed) == 2) & (F.try_variant_get(F.get(listed, F.lit(1)), "$", "string") == END)
    return parsed.isNotNull() & F.coalesce(F.when(parsed.isNotNull(), ends), F.lit(False))


def typed(pages: DataFrame, reads_json: bool) -> DataFrame:
    """Adds ``parsed``, the page's ``text`` as a variant if it is JSON, and ``is_json``; in mode ``playwright`` nothing is."""
    if not reads_json:
        return pages.withColumn("parsed", F.lit(None).cast("variant")).withColumn("is_json", F.lit(False))
    # only texts that can start a value of JSON are tried
    maybe = (F.col("mode") != "playwright") & F.col("text").rlike(r'^\s*[\[{"\d\-tfn]')
    return pages.withColumn("parsed", F.when(maybe, F.try_parse_json("text"))).withColumn("is_json", F.coalesce(whole_json(F.col("text"), F.col("parsed")), F.lit(False)))


def build(rules: list[Rule], patterns: dict[str, Pattern | ValueError], text: Column, variant: Column, is_json: Column, dom: Column) -> tuple[list[Column], list[Column]]:
    """What each rule finds, as columns ``found1``, ...; and what shapes it.

    ``dom`` has what each of ``paths_of`` finds.
    """
    finds, shapes, places = [], [], {p: k for k, p in enumerate(paths_of(rules))}

    def find(column: Column) -> Column:
        name = f"found{len(finds) + 1}"
        finds.append(column.alias(name))
        return F.col(name)

    for rule in rules:
        by_type, used = {}, {}
        for js in (True, False):
            kind = route(rule, js)
            try:
                if kind == "invalid":
                    by_type[js] = failed(rule, kind, "Empty key name")
                elif kind in ("xpath", "css"):
                    if wrong := checked_path(kind, rule.expr or ""):
                        by_type[js] = failed(rule, kind, wrong)
                    else:
                        own = F.get(dom, F.lit(places[kind, rule.expr or ""]))
                        by_type[js] = shaped(rule, kind, own["n"], own["values"], "no_data", NO_DATA)
                elif kind == "json_key":
                    by_type[js] = json_key_result(rule, find(json_key_found(rule.key, text, variant)))
                elif kind == "json_path":
                    by_type[js] = json_path_result(rule, find(json_path_found(rule.expr or "", text, variant)))
                else:
                    p = patterns[rule.key if kind == "key_regex" else rule.expr or rule.key]
                    if isinstance(p, ValueError):
                        raise p
                    if kind == "json_regex" and p.groups > 1:
                        by_type[js] = failed(rule, kind, "JSON extraction error: more than one group")
                    else:
                        used[js] = (kind, p)
            except ValueError as e:
                by_type[js] = failed(rule, kind, ("JSON error: " if js else "Extraction error: ") + str(e))
        if used:  # on pages of both types the pattern is the same
            p = next(iter(used.values()))[1]
            found = find(matches(text if len(used) == 2 else F.when(is_json if True in used else ~is_json, text), p))
            for js, (kind, _) in used.items():
                by_type[js] = json_regex_result(rule, found) if kind == "json_regex" else regex_result(rule, kind, found)
        shapes.append(F.when(is_json, by_type[True]).otherwise(by_type[False]))
    return finds, shapes


def paths_of(rules: list[Rule]) -> list[tuple[str, str]]:
    """The kinds and texts of the rules' XPaths and selectors that are sound."""
    kinds = [(route(r, js), r.expr or "") for r in rules for js in (True, False)]
    return list(dict.fromkeys((k, e) for k, e in kinds if k in ("xpath", "css") and checked_path(k, e) is None))


def patterns_of(rules: list[Rule]) -> list[str]:
    """The regular expressions of rules."""
    kinds = [(route(r, js), r) for r in rules for js in (True, False)]
    return list(dict.fromkeys(r.key if k == "key_regex" else r.expr or r.key for k, r in kinds if k in ("regex", "key_regex", "json_regex")))


def with_results(pages: DataFrame, rules, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", mode_col: str | None = None, status_col: str | None = None) -> DataFrame:
    """``page_id``, ``url``, ``page_error`` and ``results``, an array with one struct per rule.

    A page is JSON if its whole text is one JSON value; one with ``NaN`` or with
    a key twice isn't.
    """
    spark, rules = pages.sparkSession, parse_rules(rules)
    own = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(text_col).alias("text"),
        (F.coalesce(F.col(mode_col), F.lit("requests")) if mode_col else F.lit("requests")).alias("mode"),
        (F.col(status_col).cast("int") if status_col else F.lit(None).cast("int")).alias("code"),
    )
    kinds = {(r.index, js): route(r, js) for r in rules for js in (True, False)}
    reads_json = any(kinds[r.index, True].startswith("json") or kinds[r.index, True] != kinds[r.index, False] for r in rules)
    own = own.withColumn("page_error", page_error(F.col("text"), F.col("mode"), F.col("code")))
    good = F.col("page_error").isNull()
    used = typed(own, reads_json).withColumn("text", F.when(good, F.col("text")))
    if paths := [(xpath if k == "xpath" else css)(e) for k, e in paths_of(rules)]:
        # rules of pages of one type don't have those of the other parsed
        html, js = (any(kinds[r.index, x] in ("xpath", "css") for r in rules) for x in (False, True))
        read = F.lit(True) if html and js else F.col("is_json") if js else ~F.col("is_json")
        needs = reduce(Needs.__or__, (p.needs for p in paths))
        used = used.withColumn("nodes", page_nodes(F.when(read, F.col("text")), needs))
        used = used.withColumn("dom", F.transform(literal([p.path for p in paths]), lambda p: dom_found(F.col("nodes"), p)))
    finds, shapes = build(rules, checked_patterns(spark, patterns_of(rules)), F.col("text"), F.col("parsed"), F.col("is_json"), F.col("dom"))
    found = used.select("page_id", "url", "page_error", "text", "parsed", "is_json", *(["dom"] if paths else []), *finds)
    columns = [F.when(~good, failed(r, kinds[r.index, False], F.col("page_error"))).otherwise(c) for r, c in zip(rules, shapes, strict=True)]
    results = F.array(*columns) if columns else F.array().cast(f"array<{RESULT}>")
    return found.select("page_id", "url", "page_error", results.alias("results"))


def extract(pages: DataFrame, rules, **options) -> DataFrame:
    """One row per page and rule: what the rule found, in long form.

    ``pages`` has an id, a url and a text, and may have a mode and a status;
    ``options`` name the columns.  A page that can't be used has each rule's row
    with the page's error; a rule that can't be used has its error on every page.
    Repeated pages each have their rows.  Other columns are ignored.
    """
    rows = with_results(pages, rules, **options)
    # an outer explode, as Spark would else look at all results once more to leave out pages that have none
    each = F.explode_outer("results") if parse_rules(rules) else F.explode("results")
    return rows.select("page_id", "url", "page_error", each.alias("r")).select("page_id", "url", "r.*", "page_error")


def json_string(c: Column) -> Column:
    """A string as JSON text: that of an array of it, less its brackets."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def entry_value(r: Column) -> Column:
    """A result's value as JSON text; a list stays one, and so does a value that is JSON."""
    return F.when((r["status"] == "many") & (r["kind"] != "json_regex"), F.to_json(r["values"])).when((r["kind"] == "json_key") & (r["status"] == "one") & r["value"].rlike(r"^\s*[\[{]"), r["value"]).otherwise(json_string(r["value"]))


def extract_wide(pages: DataFrame, rules, *, comma: str = ",", colon: str = ":", **options) -> DataFrame:
    """One row per page with a JSON object of key and value; lists stay lists."""
    parsed = parse_rules(rules)
    rows = with_results(pages, parsed, **options)
    entry = lambda r: F.concat(json_string(r["key"]), F.lit(colon), entry_value(r))
    whole = F.concat(F.lit("{"), F.array_join(F.transform("results", entry), comma), F.lit("}"))
    error = F.concat(F.lit('{"error":'), json_string(F.col("page_error")), F.lit("}"))
    return rows.select("page_id", "url", "page_error", F.when(F.col("page_error").isNotNull(), error).otherwise(whole).alias("result"))
