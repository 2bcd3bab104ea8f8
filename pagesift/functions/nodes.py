"""The nodes of a page as an array, in document order, with only those that rules can touch."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .htmltree import Element, parse

TEXT = "#text"
#: ``pos`` counts kept elements and texts from 1; ``last`` is the place of the last
#: one inside, ``parent`` that of the element around (0 for none, -1 for one that
#: isn't kept).  ``tag`` is ``#text`` for a text, which has ``text``; an element has
#: ``attrs``.  ``up`` is the nearest element around that is kept, ``prev`` and
#: ``next`` the nearest siblings of its sort (elements or texts) that are.  On the
#: whole page, ``nth`` is its place among siblings of its sort, of which there are
#: ``of``; ``nth_tag`` and ``of_tag`` are the same for siblings of its name.
#: ``depth`` is the number of kept elements around.
FIELDS = {
    "pos": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(),
    "up": pa.int32(), "prev": pa.int32(), "next": pa.int32(), "nth": pa.int32(), "of": pa.int32(), "nth_tag": pa.int32(), "of_tag": pa.int32(), "depth": pa.int32(),
}
LAST, NEXT = list(FIELDS).index("last"), list(FIELDS).index("next")
NODE = "struct<" + ",".join(f"{k}:" + ("map<string,string>" if k == "attrs" else "string" if k in ("tag", "text") else "int") for k in FIELDS) + ">"


@dataclass(frozen=True)
class Needs:
    """What rules can touch: names of elements, names of attributes, elements whose texts count; None is all."""

    tags: frozenset[str] | None = frozenset()
    attrs: frozenset[str] | None = frozenset()
    texts: frozenset[str] | None = frozenset()

    def __or__(self, other: Needs) -> Needs:
        both = lambda a, b: None if a is None or b is None else a | b
        return Needs(both(self.tags, other.tags), both(self.attrs, other.attrs), both(self.texts, other.texts))


ALL = Needs(None, None, None)


def node_rows(root: Element, needs: Needs = ALL) -> list[list]:
    """The nodes below a tree's root that are needed, with the fields of ``NODE``."""
    rows: list[list] = []
    stack: list = []

    def enter(e: Element, parent: int, up: int, depth: int, texts: bool) -> None:
        seen: dict[str, int] = {}
        ranked, elements = [], 0
        for c in e.children:
            tag = TEXT if isinstance(c, str) else c.tag
            elements += tag is not TEXT
            seen[tag] = seen.get(tag, 0) + 1
            ranked.append((c, tag, elements if tag is not TEXT else seen[tag], seen[tag]))
        near = {True: 0, False: 0}  # the last kept text and element among these siblings
        for c, tag, nth, nth_tag in reversed(ranked):
            stack.append((c, tag, parent, up, depth, texts, nth, elements if tag is not TEXT else seen[tag], nth_tag, seen[tag], near))

    enter(root, 0, 0, 0, needs.texts is None)
    while stack:
        x = stack.pop()
        if isinstance(x, int):  # all inside the element at this place is done
            rows[x - 1][LAST] = len(rows)
            continue
        c, tag, parent, up, depth, texts, nth, of, nth_tag, of_tag, near = x
        is_text = tag is TEXT
        kept = texts if is_text else needs.tags is None or tag in needs.tags
        pos = len(rows) + 1
        if kept:
            before, near[is_text] = near[is_text], pos
            if before:
                rows[before - 1][NEXT] = pos
            attrs = None if is_text else [(k, v) for k, v in c.attrs.items() if needs.attrs is None or k in needs.attrs] if needs.attrs is None or needs.attrs else []
            rows.append([pos, pos, parent, tag, attrs, c if is_text else None, up, before, 0, nth, of, nth_tag, of_tag, depth])
        if not is_text and c.children:
            if kept:
                stack.append(pos)
                enter(c, pos, pos, depth + 1, texts or tag in needs.texts)
            else:
                enter(c, -1, up, depth, texts)
    return rows


def listed(texts: pa.Array, needs: Iterable[Needs]) -> pa.Array:
    ends, null, columns = [0], [], [[] for _ in FIELDS]
    for t, own in zip(texts, needs, strict=False):
        source = t.as_py()
        null.append(source is None)
        if source is not None:
            for c, v in zip(columns, zip(*node_rows(parse(source), own), strict=True), strict=False):
                c.extend(v)
        ends.append(len(columns[0]))
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(null, pa.bool_()))


def page_nodes(text: Column, needs: Needs | Column = ALL) -> Column:
    """The nodes of a page; null for a null text.

    ``needs`` may be a column with ``tags``, ``attrs`` and ``texts``, arrays of
    names of which a null one is all.
    """
    if isinstance(needs, Needs):
        return F.arrow_udf(lambda texts: listed(texts, (needs for _ in texts)), f"array<{NODE}>")(text)

    def by_row(texts: pa.Array, *names: pa.Array) -> pa.Array:
        sets = ((None if x.as_py() is None else frozenset(x.as_py()) for x in own) for own in zip(*names, strict=True))
        return listed(texts, (Needs(*own) for own in sets))

    return F.arrow_udf(by_row, f"array<{NODE}>")(text, *(needs[k] for k in ("tags", "attrs", "texts")))


def is_element(n: Column) -> Column:
    return n["tag"] != TEXT


def within(nodes: Column, n: Column) -> Column:
    """The nodes inside a node: they follow it, up to its last one."""
    return F.slice(nodes, n["pos"] + 1, n["last"] - n["pos"])


def string_value(nodes: Column, n: Column) -> Column:
    """The text of all that is inside a node, or a text itself."""
    texts = F.filter(within(nodes, n), lambda t: t["tag"] == TEXT)
    return F.when(n["tag"] == TEXT, n["text"]).otherwise(F.array_join(F.transform(texts, lambda t: t["text"]), ""))
