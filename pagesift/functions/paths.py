"""The forms of XPath and CSS that rules have, as steps over a page's nodes.

A path is data: a list of steps, each of which says how its nodes lie to those of
the step before, their name, and what they have to meet.  One expression runs any
list of steps over the array that ``nodes.page_nodes`` gives, so plans don't grow
with rules, and rules may as well come from a table.  A set of nodes is an array
of flags by place.  Steps look up the flag of a parent or a sibling; what lies
anywhere above or before is counted along these links by doubling them, so a step
takes time in proportion to the nodes, times the logarithm of the depth.

What isn't one of these forms is an error before any page is read: steps by ``/``
and ``//``, names, ``*``, ``text()``, ``..``, ``@name`` at the end, unions, a number
for a path in brackets, and conditions on attributes, texts, children and places;
for CSS names, ids, classes, attributes, places among siblings, the four
combinators and commas.
"""

from __future__ import annotations

import contextlib
import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodes import TEXT, Needs, string_value, within

ANY = "#node"
PATH = "struct<arms:array<struct<steps:array<struct<link:string,tag:string,tests:array<struct<what:string,name:string,op:string,value:string,k:int,no:boolean>>,k:int>>,rank:int,pick:int>>,attrs:array<string>,pick:int>"
#: A node that is found is its place and, below these bits, which attribute is shown of it (0 for none).
RANKS = 16


class PathError(ValueError):
    """A path or selector that isn't of a form that rules have."""


class Found(NamedTuple):
    """A path as data, what it needs of a page, the nodes that it finds, in document order, and how one of them is shown."""

    path: dict
    needs: Needs

    def found(self, nodes: Column) -> Column:
        return found(nodes, literal([self.path])[0])

    def shown(self, nodes: Column, f: Column) -> Column:
        return shown(nodes, literal([self.path])[0], f)


def literal(paths: list[dict]) -> Column:
    """Paths as a constant array."""
    return F.from_json(F.lit(json.dumps(paths)), f"array<{PATH}>")


def test(what: str, name: str = "", op: str = "", value: str = "", k: int = 0, no: bool = False) -> dict:
    """A condition that one node meets by itself."""
    return {"what": what, "name": name, "op": op, "value": value, "k": k, "no": no}


def step(link: str, tag: str, tests: list[dict] | None = None, k: int = 0) -> dict:
    return {"link": link, "tag": tag, "tests": tests or [], "k": k}


_STRING = r"""(?:"([^"]*)"|'([^']*)')"""
_STEP = re.compile(r"""(//|/)?\s*(\.\.|\.|@?[A-Za-z_][\w.:-]*|@?\*|text\(\)|node\(\))(\(\))?\s*((?:\[(?:[^\]"']|"[^"]*"|'[^']*')*\]\s*)*)""")
_CONDITION = re.compile(r"""\[((?:[^\]"']|"[^"]*"|'[^']*')*)\]""")
_PART = re.compile(r"""(?:[^|"'\[\]]|"[^"]*"|'[^']*'|\[(?:[^\]"']|"[^"]*"|'[^']*')*\])+""")
_GROUP = re.compile(r"\((.*)\)\s*\[\s*(\d+|last\(\))\s*\]\s*(.*)", re.DOTALL)
_OPERANDS = {"text()": "text", ".": "self"}


def condition(text: str) -> list[dict]:
    """The tests of a condition, all of which a node has to meet."""
    text = text.strip()
    if len(parts := re.split(rf"\s+and\s+(?=(?:[^\"']|{_STRING.replace('(', '(?:').replace('(?:?:', '(?:')})*$)", text)) > 1:
        return [t for x in parts for t in condition(x)]
    if m := re.fullmatch(r"not\s*\((.*)\)", text, re.DOTALL):
        inner = condition(m[1])
        if len(inner) > 1:
            raise PathError(f"unsupported condition [{text}]")
        return [t | {"no": not t["no"]} for t in inner]
    operand = lambda x: ("attr", x[1:].lower()) if x.startswith("@") else (_OPERANDS[x], "")
    if m := re.fullmatch(rf"(contains|starts-with)\s*\(\s*(@[\w:-]+|text\(\)|\.)\s*,\s*{_STRING}\s*\)", text):
        return [test(*operand(m[2]), m[1], m[3] if m[3] is not None else m[4])]
    if m := re.fullmatch(rf"(@[\w:-]+|text\(\)|\.)\s*(?:(!?=)\s*{_STRING})?", text):
        return [test(*operand(m[1]), m[2] or "", (m[3] if m[3] is not None else m[4]) or "")]
    if re.fullmatch(r"[A-Za-z][\w-]*", text):
        return [test("child", text.lower())]
    raise PathError(f"unsupported condition [{text}]")


def place(text: str) -> int:
    """A place among siblings, -1 for the last and -2 for one that nothing has; 0 if the condition is none."""
    text = text.strip()
    return -1 if text == "last()" else int(text) or -2 if re.fullmatch(r"\d+", text) else 0


def placed(steps: list[dict], texts: list[str]) -> None:
    """Add conditions to the last step, or further steps behind it where a place counts what is left."""
    tag, fresh = steps[-1]["tag"], True
    for text in texts:
        if k := place(text):
            if tag == ANY:
                raise PathError(f"unsupported place [{text}]")
            if fresh:
                steps[-1]["tests"].append(test("nth" if tag == "*" else "nth_tag", k=k))
            else:
                steps.append(step("place", tag, k=k))
        else:
            if steps[-1]["link"] == "place":
                steps.append(step("self", tag))
            steps[-1]["tests"] += condition(text)
        fresh = False


def needed(steps: list[dict], attr: str | None) -> Needs:
    """What a list of steps can touch."""
    tags, attrs, texts = set(), {attr} - {None}, set()
    around = None  # the name of the step before
    for k, s in enumerate(steps):
        if s["tag"] == TEXT:
            texts.add(around)
        else:
            tags.add(None if s["tag"] in ("*", ANY) or s["link"] in ("next", "up") else s["tag"])
            around = None if s["tag"] in ("*", ANY) else s["tag"]
            if k == len(steps) - 1 and attr is None:
                texts.add(around)
        for t in s["tests"]:
            tags |= {t["name"]} if t["what"] == "child" else set()
            attrs |= {t["name"]} if t["what"] == "attr" else set()
            texts |= {around} if t["what"] in ("text", "self") else set()
    return Needs(*(None if None in x else frozenset(x) for x in (tags, attrs, texts)))


def arm(source: str) -> tuple[dict, str | None, Needs]:
    """One path of a union, the attribute that it shows, and what it needs."""
    source = source.strip()
    if m := _GROUP.fullmatch(source):
        if m[3]:
            raise PathError(f"unsupported {m[3]!r}")
        inner, attribute, needs = arm(m[1])
        if inner["pick"]:
            raise PathError(f"unsupported {source[:20]!r}")
        return inner | {"pick": place(m[2])}, attribute, needs
    steps, at, attribute = [], 0, None
    text = source[1:] if source.startswith(".//") else source
    while at < len(text):
        m = _STEP.match(text, at)
        name = m and m[2] + (m[3] or "")
        if not m or attribute or (m[3] and name not in ("text()", "node()")) or "::" in name or (at and not m[1]) or (not at and m[1] is None):
            raise PathError(f"unsupported {text[at:][:20]!r}")
        conditions = _CONDITION.findall(m[4])
        if name.startswith("@"):
            attribute = name[1:].lower()
            if conditions or not steps or attribute == "*":
                raise PathError(f"unsupported {text[at:][:20]!r}")
            if m[1] == "//":
                steps.append(step("inside", "*"))
            steps.append(step("self", steps[-1]["tag"], [test("attr", attribute)]))
        else:
            if name in (".", "..") and (not steps or m[1] == "//"):
                raise PathError(f"unsupported {text[at:][:20]!r}")
            link = {".": "self", "..": "up"}.get(name) or {"/": "child", "//": "inside"}[m[1]]
            if not steps:
                link = {"child": "top", "inside": "any"}[link]
            tag = {"text()": TEXT, "node()": ANY, "..": ANY, ".": ANY}.get(name, name.lower())
            steps.append(step(link, tag))
            placed(steps, conditions)
        at = m.end()
    if not steps:
        raise PathError(f"unsupported {source[:20]!r}")
    return {"steps": steps, "rank": 0, "pick": 0}, attribute, needed(steps, attribute)


def xpath(source: str) -> Found:
    """An XPath that rules may have."""
    if (m := _GROUP.fullmatch(source.strip())) and "|" in m[1] and not m[3]:  # a place in a union, unless these are brackets of two arms
        with contextlib.suppress(PathError):
            inner = xpath(m[1])
            return inner._replace(path=inner.path | {"pick": place(m[2])})
    parts = [m[0] for m in _PART.finditer(source)]
    if not parts or "|".join(parts) != source.strip("\n") or any(not p.strip() for p in parts):
        raise PathError(f"unsupported {source[:20]!r}")
    arms = [arm(p) for p in parts]
    # an attribute comes after its element, in the order of the arms; the same one once
    attrs = [None, *dict.fromkeys(a for _, a, _ in arms if a)]
    return Found({"arms": [x | {"rank": attrs.index(a)} for x, a, _ in arms], "attrs": attrs, "pick": 0}, reduce(Needs.__or__, (n for *_, n in arms)))


_SIMPLE = re.compile(rf"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*~|]?=)\s*(?:{_STRING}|(?P<bare>[^\s\]"']+))\s*)?\]|:(?P<pseudo>first-child|last-child|nth-child\(\s*(?P<n>\d+)\s*\))""")
_BETWEEN = re.compile(r"\s*([>+~,])\s*|\s+")
_LINKS = {" ": "inside", ">": "child", "+": "next", "~": "later"}
_OPS = {None: "", "=": "=", "^=": "starts-with", "$=": "ends", "*=": "contains", "~=": "word", "|=": "dash"}


def simple(m: re.Match) -> dict:
    """One part of a compound selector other than a name."""
    if m["id"]:
        return test("attr", "id", "=", m["id"])
    if m["cls"]:
        return test("attr", "class", "word", m["cls"])
    if m["attr"]:
        value = next((v for v in (m["bare"], *m.groups()[5:7]) if v is not None), "")
        return test("attr", m["attr"].lower(), "never" if m["op"] in ("^=", "$=", "*=") and not value else _OPS[m["op"]], value)
    return test("nth", k=-1 if m["pseudo"] == "last-child" else int(m["n"] or 1) or -2)


def css(source: str) -> Found:
    """A selector that rules may have."""
    groups: list[list[dict]] = [[step("any", "*")]]
    said, at, text = False, 0, source.strip()  # whether the last compound says anything
    while at < len(text):
        if m := _SIMPLE.match(text, at):
            if m["tag"]:
                if said:
                    raise PathError(f"unsupported {text[at:][:20]!r}")
                groups[-1][-1]["tag"] = m["tag"].lower()
            else:
                groups[-1][-1]["tests"].append(simple(m))
            said = True
        elif (m := _BETWEEN.match(text, at)) and said:
            if m[1] == ",":
                groups.append([step("any", "*")])
            else:
                groups[-1].append(step(_LINKS[m[1] or " "], "*"))
            said = False
        else:
            raise PathError(f"unsupported {text[at:][:20]!r}")
        at = m.end()
    if not said:
        raise PathError("an empty selector")
    return Found({"arms": [{"steps": g, "rank": 0, "pick": 0} for g in groups], "attrs": [None], "pick": 0}, reduce(Needs.__or__, (needed(g, None) for g in groups)))


# From here on steps are columns.  An expression is written out once wherever it can
# be: Spark looks at all of it again for each lambda around it.


def holds(v: Column, op: Column, value: Column) -> Column:
    return (
        F.when(op == "", v.isNotNull())
        .when(op == "=", v == value)
        .when(op == "!=", v != value)
        .when(op == "contains", v.contains(value))
        .when(op == "starts-with", v.startswith(value))
        .when(op == "ends", v.endswith(value))
        .when(op == "word", F.array_contains(F.split(v, r"\s+"), value))
        .when(op == "dash", (v == value) | v.startswith(F.concat(value, F.lit("-"))))
    )


def meets(nodes: Column, n: Column, t: Column) -> Column:
    """Whether a node meets one test."""
    what, k = t["what"], t["k"]
    own = F.when(what == "attr", n["attrs"][t["name"]]).when(what == "self", string_value(nodes, n))
    child = lambda c: (c["parent"] == n["pos"]) & F.when(what == "child", c["tag"] == t["name"]).otherwise((c["tag"] == TEXT) & holds(c["text"], t["op"], t["value"]))
    by_tag = what == "nth_tag"
    nth, of = F.when(by_tag, n["nth_tag"]).otherwise(n["nth"]), F.when(by_tag, n["of_tag"]).otherwise(n["of"])
    yes = F.when(what.isin("attr", "self"), holds(own, t["op"], t["value"])).when(what.isin("text", "child"), F.exists(within(nodes, n), child)).otherwise(F.when(k > 0, nth == k).otherwise((k == -1) & (nth == of)))
    return F.coalesce(yes, F.lit(False)) != t["no"]


def after(nodes: Column, flags: Column, s: Column) -> Column:
    """Flags of the nodes that one step leads to from the flagged ones.

    Of each node the flag that its link leads to is looked up.  Where links are
    followed on (to all elements around, or siblings before or behind), flagged
    nodes along them are counted: in each round every count takes in the count
    of the node that its link leads to, and the link becomes twice as long.
    """
    link, tag, k = s["link"], s["tag"], s["k"]
    to = lambda n: F.when(link == "child", n["parent"]).when(link == "inside", n["up"]).when(link.isin("next", "later") | ((link == "place") & (k > 0)), n["prev"]).when(link == "place", n["next"]).otherwise(n["pos"])
    first = lambda n: F.when(link == "top", n["parent"] == 0).when(link == "up", F.exists(within(nodes, n), lambda c: (c["parent"] == n["pos"]) & F.get(flags, c["pos"] - 1))).otherwise(F.get(flags, to(n) - 1))
    start = F.struct(F.transform(nodes, lambda n: F.when(first(n), 1).otherwise(0)).alias("c"), F.transform(nodes, to).alias("to"))
    longest = F.array_max(F.transform(nodes, lambda n: F.when(link == "inside", n["depth"]).when(link.isin("later", "place"), n["of"]).otherwise(0)))
    rounds = F.slice(F.sequence(F.lit(1), F.lit(31)), F.lit(1), F.ceil(F.log2(F.coalesce(longest, F.lit(0)) + 1)).cast("int"))
    twice = lambda a, _: F.struct(
        F.transform(a["c"], lambda c, i: c + F.coalesce(F.get(a["c"], F.get(a["to"], i) - 1), F.lit(0))).alias("c"),
        F.transform(a["to"], lambda x: F.coalesce(F.get(a["to"], x - 1), F.lit(0))).alias("to"),
    )
    near = lambda c, i: F.when(link == "place", F.get(flags, i) & (c == F.when(k > 0, k - 1).when(k == -1, 0).otherwise(-1))).otherwise(c > 0)
    named = lambda n: F.when(tag == "*", n["tag"] != TEXT).when(tag == ANY, True).otherwise(n["tag"] == tag)
    end = lambda a: F.transform(nodes, lambda n, i: near(F.get(a["c"], i), i) & named(n) & F.forall(s["tests"], lambda t: meets(nodes, n, t)))
    return F.aggregate(rounds, start, twice, end)


def picked(values: Column, k: Column) -> Column:
    return F.slice(values, F.when(k == 0, 1).when(k == -2, 1).otherwise(k), F.when(k == 0, (1 << 31) - 1).when(k == -2, 0).otherwise(1))


def found(nodes: Column, path: Column) -> Column:
    """The nodes that a path finds, once each and in document order."""
    all_ = F.transform(nodes, lambda n: F.lit(True))
    end = lambda flags: F.filter(F.transform(nodes, lambda n, i: F.when(F.get(flags, i), n["pos"].cast("long"))), lambda x: x.isNotNull())
    of = lambda a: F.transform(picked(F.aggregate(a["steps"], all_, lambda flags, s: after(nodes, flags, s), end), a["pick"]), lambda x: x * (1 << RANKS) + a["rank"])
    return picked(F.array_sort(F.array_distinct(F.flatten(F.transform(path["arms"], of)))), path["pick"])


def shown(nodes: Column, path: Column, f: Column) -> Column:
    """What is shown of a node that was found: an attribute, or the text inside."""
    n, attr = F.get(nodes, F.shiftright(f, RANKS).cast("int") - 1), F.get(path["attrs"], f.bitwiseAND((1 << RANKS) - 1).cast("int"))
    return F.when(attr.isNotNull(), n["attrs"][attr]).otherwise(string_value(nodes, n))
