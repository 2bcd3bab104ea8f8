"""Main text of pages by wrapper induction.

The pages of a host come from one template.  The host's first page gives its
tree; the trees of all its pages are aligned with it by simple tree matching,
and what a place holds is compared over the pages.  Places that say the same on
nearly all of the host's distinct pages are template, the others are slots.  The
content is the smallest part of the template that has the slots in which pages
say different things, menus and other links aside; a page's main text is what
its slots say there.  An element that says it is the article settles where the
slots leave room, and stands for the content on hosts too small to compare.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.htmltree import BLOCK, Element, parse

from .common import fits, hot_keys, join_hot, table, texts_of, written

#: A place is template if at least so many distinct pages, and so large a part
#: of the host's distinct pages, have it and all of them say the same there.  On
#: fewer pages equal words are no sign of a template.
LEAST_PAGES, NEARLY_ALL = 5, 0.9
#: Slots with less of a host's varying text than this don't widen the content, but for headings.
SMALL = 0.02
#: Hosts whose wrappers may be broadcast, and bytes of these.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 64 << 20
#: Parts that stand side by side with one label are places of their own up to so many.
SIDE_BY_SIDE = 8
#: Cells of the table that aligns the parts of two places; larger ones are filled along the diagonal.
TABLE_CELLS = 20_000
PARTS = frozenset("div section article main aside header footer nav form table ul ol dl".split())

#: Elements that are never part of an article, and names that mark such parts.
ASIDE = frozenset("aside button canvas dialog footer form head iframe input label menu nav noscript object script select style svg template textarea".split())
NAMED = re.compile(
    r"(?:ad|ads|adv|banner|bottom-bar|breadcrumbs?|byline-share|colophon|consent|copyright|disqus|feedback|footer|gdpr|hidden|legal|login|masthead|menu|modal|nav|navbar|navigation|notice|notification|overlay|pager|pagination|paywall|popup|print-only|rail|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip-link|social|sponsored|subscribe|tags|toolbar|topbar|widget)"
    r"|(?:ad|ads|advert|advertisement|comment|comments|cookie|cookies|newsletter|outbrain|promo|promoted|promotion|sidebar|site-footer|site-header|sponsor|taboola)(?:[-_].*)?"
    r"|.*[-_](?:ad|ads|advert|comments?|sidebar|menu|nav|footer|newsletter|promo)"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_wrappers: dict[str, Template] = {}


def is_aside(e: Element) -> bool:
    """Whether an element is a menu, notice, advert, form, comment section or the like."""
    if e.tag in ASIDE:
        return True
    if not e._raw:
        return e.tag == "header" and not inside(e, "article", "main")
    a = e.attrs
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if e.tag in ("article", "body", "html", "main"):
        names = a.get("class", "").lower().split()
        return e.tag == "article" and any(x.startswith("comment") for x in names)
    if e.tag == "header" and not inside(e, "article", "main"):
        return True
    return any(NAMED.fullmatch(x) for x in (a.get("class", "") + " " + a.get("id", "")).lower().split())


def inside(e: Element, *tags: str) -> bool:
    while (e := e.parent) is not None:
        if e.tag in tags:
            return True
    return False


def label(e: Element) -> str:
    return f"{e.tag}.{e.attrs.get('class', '')}" if e._raw else e.tag


def runs(elements: list[Element]) -> list[list[Element]]:
    """Neighbours of one label together: the repeats of a record are one place of a template.

    A few parts of a page with one label may be different things, and stay apart.
    """
    out: list[list[Element]] = []
    for e in elements:
        if out and label(out[-1][0]) == label(e):
            out[-1].append(e)
        else:
            out.append([e])
    return [x for run in out for x in ([[e] for e in run] if run[0].tag in PARTS and len(run) <= SIDE_BY_SIDE else [run])]


class Template:
    """A place of a host's template and those below it."""

    __slots__ = ("name", "label", "below")

    def __init__(self, name: int, label: str, below: list[Template]):
        self.name, self.label, self.below = name, label, below

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    def paths(self, above: tuple[Template, ...] = ()) -> Iterator[tuple[Template, ...]]:
        """This place and all below, each with what it lies in, from the top."""
        yield (*above, self)
        for x in self.below:
            yield from x.paths((*above, self))

    @classmethod
    def induce(cls, root: Element) -> str:
        """The template that one page's tree gives, as JSON: lists of a label and what is below.

        What lies deeper than 100 elements belongs to the place there: trees are
        walked by recursion, and only broken pages are that deep.
        """

        def made(e: Element, depth: int) -> list:
            return [label(e), [made(run[0], depth + 1) for run in runs(e.elements())] if depth < 100 else []]

        return json.dumps(made(root, 0), ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Template:
        n = 0

        def made(x: list) -> Template:
            nonlocal n
            n += 1
            return cls(n, x[0], [made(y) for y in x[1]])

        return made(json.loads(text))


class Matching:
    """Simple tree matching of a template with a page: alignments that keep levels and order, as large as they can be.

    What two places have in common is found once.  Where a place and an element
    have very many parts, equal parts at both ends are aligned first, and of the
    table of the others only a band around its diagonal is filled, of
    ``TABLE_CELLS`` cells or eight to a row, so that time grows as the page.
    """

    def __init__(self):
        self._parts: dict[int, list[list[Element]]] = {}
        self._found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def parts(self, e: Element) -> list[list[Element]]:
        if id(e) not in self._parts:
            self._parts[id(e)] = runs(e.elements())
        return self._parts[id(e)]

    def size(self, t: Template, e: Element) -> int:
        """How many places the two have in common, themselves included."""
        return 1 + self.aligned(t, e)[0]

    def aligned(self, t: Template, e: Element) -> tuple[int, list[tuple[int, int]]]:
        """What the parts of both have in common, and which parts lie at which place."""
        key = (t.name, id(e))
        if key not in self._found:
            self._found[key] = self._align(t.below, self.parts(e))
        return self._found[key]

    def _align(self, a: list[Template], b: list[list[Element]]) -> tuple[int, list[tuple[int, int]]]:
        names = [label(run[0]) for run in b]
        n, m, first, total, pairs = len(a), len(b), 0, 0, []
        wide = n * m > TABLE_CELLS
        if wide:
            while first < min(n, m) and a[first].label == names[first]:
                pairs.append((first, first))
                first += 1
            while min(n, m) > first and a[n - 1].label == names[m - 1]:
                n, m = n - 1, m - 1
                pairs.append((n, m))
            total = sum(self.size(a[i], b[j][0]) for i, j in pairs)
        rows, columns = n - first, m - first
        if not rows or not columns:
            return total, pairs
        half = max(4, TABLE_CELLS // rows // 2) if wide else columns
        before, start, choices = [0] * (columns + 1 if not wide else 1), 0, []
        for i in range(1, rows + 1):
            middle = i * columns // rows
            lo, hi = max(0, middle - half), min(columns, middle + half)
            row, choice = [], bytearray(hi - lo + 1)
            x = a[first + i - 1]
            above = lambda j: before[min(j - start, len(before) - 1)] if j >= start else 0  # noqa: B023, E731
            for j in range(lo, hi + 1):
                up, left = above(j), row[-1] if row else 0
                here = above(j - 1) + self.size(x, b[first + j - 1][0]) if j and x.label == names[first + j - 1] else 0
                # of equal ones a place without a part goes before a part without a place
                best = max(up, left, here)
                choice[j - lo] = 0 if best == up else 1 if best == left else 2
                row.append(best)
            choices.append((lo, choice))
            before, start = row, lo
        i, j = rows, columns
        while i and j:
            lo, choice = choices[i - 1]
            j = min(j, lo + len(choice) - 1)
            c = choice[j - lo] if j >= lo else 0
            if c == 0:
                i -= 1
            elif c == 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((first + i, first + j))
        return total + before[-1], pairs

    def places(self, t: Template, e: Element) -> dict[int, list[Element]]:
        """The elements at each place of a template below its top."""
        found: dict[int, list[Element]] = {}
        stack = [(t, e)]
        while stack:
            t, e = stack.pop()
            for i, j in self.aligned(t, e)[1]:
                members = self.parts(e)[j]
                found.setdefault(t.below[i].name, []).extend(members)
                stack += [(t.below[i], x) for x in members]
        return found


def match(t: Template, e: Element) -> int:
    """The size of the largest alignment of two trees."""
    return Matching().size(t, e)


def own_text(e: Element) -> str:
    return " ".join(" ".join(c for c in e.children if isinstance(c, str)).split())


def wrapper(skeleton: str) -> Template:
    if skeleton not in _wrappers:
        if len(_wrappers) > 1000:
            _wrappers.clear()
        _wrappers[skeleton] = Template.load(skeleton)
    return _wrappers[skeleton]


def aligned(skeleton: str, root: Element) -> dict[int, list[Element]]:
    return Matching().places(wrapper(skeleton), root)


def unread(root: Element) -> set[int]:
    """The elements that lie in asides or links."""
    out: set[int] = set()
    stack = [(root, False)]
    while stack:
        e, inside_ = stack.pop()
        inside_ = inside_ or e is not root and (e.tag == "a" or is_aside(e))
        if inside_:
            out.add(id(e))
        stack.extend((c, inside_) for c in e.elements())
    return out


def said(elements: list[Element]) -> int:
    """A number for what the elements at a place say; 0 if nothing."""
    text = "\0".join(own_text(e) for e in elements)
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=7).digest(), "big") + 1 if text.strip("\0") else 0


def main_parts(root: Element) -> list[Element]:
    """The articles of a page, or what holds most of its text."""
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main" or e.attrs.get("role") == "main"):
        out, stack = [], [root]
        while stack:
            e = stack.pop()
            if e is not root and is_aside(e):
                continue
            if e is not root and wanted(e):
                out.append(e)
            else:
                stack.extend(reversed(e.elements()))
        if out:
            return out
    part = root
    while True:  # go down as long as one part has most of the text
        sizes = [(len(slot_text([c], set())), c) for c in part.elements() if not is_aside(c) and c.tag != "p"]
        size, largest = max(sizes, key=lambda x: x[0], default=(0, None))
        if largest is None or size < 0.7 * len(slot_text([part], set())):
            return [part]
        part = largest


def slot_text(parts: list[Element], template: set[int]) -> str:
    """The text of ``parts`` in page order: blocks joined by a blank, without asides and ``template`` places."""
    blocks: list[str] = []
    inline: list[str] = []

    def end() -> None:
        if text := " ".join("".join(inline).split()):
            blocks.append(text)
        inline.clear()

    stack: list[Element | str | None] = list(reversed(parts))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            inline.append(x)
        elif x.tag == "br":
            inline.append(" ")
        elif not is_aside(x):
            if x.tag in BLOCK:
                end()
                stack.append(None)
            constant = id(x) in template
            stack.extend(c for c in reversed(x.children) if not (constant and isinstance(c, str)))
    end()
    return " ".join(blocks)


def decide(template: Template, stats: dict[int, tuple[float, int, int, float]], pages: int) -> tuple[list[int], list[int]]:
    """Places of a host's template that aren't slots, and those that hold the content, if its pages tell.

    ``stats`` has for a place on how many distinct pages it is, the least and
    the greatest of what they say, and how many characters of that can be read.
    """
    varied = {p: chars for p, (_, lo, hi, chars) in stats.items() if lo != hi}
    if pages < LEAST_PAGES or not varied:  # pages that say the same everywhere show no template
        return [], []
    constant = sorted(p for p, (n, lo, hi, _) in stats.items() if lo == hi != 0 and n >= max(LEAST_PAGES, NEARLY_ALL * pages))
    mass, paths = sum(varied.values()), {path[-1].name: path for path in template.paths()}
    wide = [paths[p] for p, chars in varied.items() if chars and (chars >= SMALL * mass or re.fullmatch("h[1-6]", paths[p][-1].tag))]
    if not wide:
        return constant, []
    shared = 0
    while all(len(x) > shared + 1 and x[shared] is wide[0][shared] for x in wide):  # a slot itself isn't where slots lie
        shared += 1
    content = wide[0][: max(1, shared)]
    articles = [x for x in content if x.tag in ("article", "main")]
    if not articles:  # which of those inside have most of what varies there
        below = [path[-1] for path in paths.values() if path[-1].tag in ("article", "main") and content[-1] in path and not any(x.tag in ("article", "main") for x in path[:-1])]
        held = sum(chars for p, chars in varied.items() if any(x in below for x in paths[p]))
        articles = below if held >= 0.5 * mass else []
    found = [x.name for x in articles[:1] if x in content] or [x.name for x in articles] or [content[-1].name]
    return constant, [p for p in found if p in stats and stats[p][0] >= 0.5 * pages]


def main_text(source: str | None, skeleton: str | None = None, template: list[int] | None = None, content: list[int] | None = None) -> str:
    """The main text of one page; ``template`` names the places of the skeleton that aren't slots, ``content`` those of the content."""
    if not source:
        return ""
    root = parse(source)
    fixed: set[int] = set()
    parts: list[Element] = []
    if skeleton and (template or content):
        wanted, region = set(template or ()), set(content or ())
        for name, found in aligned(skeleton, root).items():
            if name in wanted:
                fixed.update(id(e) for e in found)
            if name in region:
                parts.extend(e for e in found if not is_aside(e))
    if not parts or any(e.tag in ("article", "main") for e in parts):  # a page may have more articles than the first one
        parts = main_parts(root)
    return slot_text(sorted(parts, key=lambda e: e.place), fixed)


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^\w+://([^/?#]*)", 1)), F.lit(""))


def with_wrapper(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``rows`` with the wrapper of their host, of which ``wrappers`` has one for each, with the number of its ``rows``.

    Wrappers are broadcast if all fit; else those of hosts with many pages are,
    and pages of other hosts are shuffled.
    """
    size = F.octet_length("skeleton")
    if fits(wrappers, BROADCAST_HOSTS, size, BROADCAST_BYTES):
        return rows.join(F.broadcast(wrappers.drop("rows")), "host")
    if fits(hot_keys(wrappers, "rows"), BROADCAST_HOSTS, size, BROADCAST_BYTES):
        return join_hot(rows, wrappers, ["host"], "rows").drop("rows")
    return rows.join(wrappers.drop("rows"), "host")


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``skeleton``, ``template``, ``content`` and ``rows``, of every host of a table of ``page_id``, ``host``, ``html``.

    Pages of the same bytes count as one.
    """
    page = F.coalesce("html", F.lit(""))
    counts = written(pages.groupBy("host", F.xxhash64(page).alias("digest"), (page == "").alias("blank")).agg(F.count(F.lit(1)).alias("copies")), "counts")
    copied = written(counts.where("copies > 1 AND NOT blank").select("host", "digest", "copies"), "copied")
    hosts = counts.groupBy("host").agg(F.sum("copies").alias("rows"), F.sum(F.when(F.col("blank"), 0).otherwise(1)).alias("pages"))
    full = pages.where("html IS NOT NULL AND html != ''").withColumn("digest", F.xxhash64("html"))
    # the first page of a host by its id and digest alone, then its html: one page for each host
    least = written(full.groupBy("host").agg(F.min(F.struct("page_id", "digest")).alias("x")).select(F.col("host").alias("of"), F.col("x.page_id").alias("id"), F.col("x.digest").alias("d")), "least")
    least = F.broadcast(least) if fits(least, BROADCAST_HOSTS * 20, F.octet_length("of"), BROADCAST_BYTES) else least.hint("shuffle_hash")
    same = (F.col("host") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))
    first = full.join(least, same, "left_semi").select("host", "html", "digest").dropDuplicates(["host", "digest"]).select("host", "html")

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Template.induce(parse(x.as_py())) for x in b.column(1)], pa.string())], ["host", "skeleton"])

    made = written(first.mapInArrow(skeletons, "host string, skeleton string").join(hosts, "host", "right"), "skeletons")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}  # of a task: pages, least and greatest of what is said, characters

        def out() -> pa.RecordBatch:
            rows = [(h, p, *x) for (h, p), x in seen.items()]
            seen.clear()
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "place", "n", "lo", "hi", "chars"])

        for b in batches:
            for host, skeleton, source, share in zip(*(c.to_pylist() for c in b.columns), strict=True):
                root = parse(source)
                skip = unread(root)
                for place, elements in aligned(skeleton, root).items():
                    s = said(elements)
                    chars = share * sum(len(own_text(e)) for e in elements if id(e) not in skip)
                    if x := seen.get((host, place)):
                        x[:] = x[0] + share, min(x[1], s), max(x[2], s), x[3] + chars
                    else:
                        seen[host, place] = [share, s, s, chars]
            if len(seen) > 100_000:
                yield out()
        if seen:
            yield out()

    # each of n copies counts for 1/n, so that they are one page together
    rows = join_copies(full, copied)
    rows = with_wrapper(rows, made.drop("pages")).select("host", "skeleton", "html", (1 / F.col("copies")).alias("share"))
    places = rows.mapInArrow(compare, "host string, place int, n double, lo long, hi long, chars double").groupBy("host", "place").agg(F.round(F.sum("n")).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"))
    per_host = places.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "n", "lo", "hi", "chars"))).alias("places"))  # as many as the host's first page has

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for skeleton, pages, stats in zip(*(b.column(c).to_pylist() for c in ("skeleton", "pages", "places")), strict=True):
                found.append(decide(Template.load(skeleton), {x["place"]: (x["n"], x["lo"], x["hi"], x["chars"]) for x in stats}, pages) if skeleton and stats else ([], []))
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("skeleton"), *lists, b.column("rows")], ["host", "skeleton", "template", "content", "rows"])

    told = made.join(per_host, "host", "left").select("host", "skeleton", "pages", "places", "rows")
    return written(told.mapInArrow(decided, "host string, skeleton string, template array<int>, content array<int>, rows long"), "wrappers")


def join_copies(full: DataFrame, copied: DataFrame) -> DataFrame:
    """``full`` with ``copies``, how many rows have a page's bytes."""
    side = copied.select(F.col("host").alias("host_"), F.col("digest").alias("digest_"), "copies")
    if fits(copied, BROADCAST_HOSTS * 20, F.octet_length("host"), BROADCAST_BYTES):
        side = F.broadcast(side)
    found = full.join(side, (F.col("host") == F.col("host_")) & (F.col("digest") == F.col("digest_")), "left")
    return found.withColumn("copies", F.coalesce("copies", F.lit(1))).drop("host_", "digest_")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` for every row of ``pages``.

    A null, empty or unreadable page has an empty text.  A page that doesn't
    align with its host's content, or is of a host with fewer than
    ``LEAST_PAGES`` distinct pages, has the text of its article or main part,
    and without one that of what holds most of its text.  Pages without a url
    are taken as one host.  Repeated rows each give a row; other columns are
    ignored; an empty table gives no rows.
    """
    own = texts_of(pages, id_col, html_col, F.col(url_col).alias("url"), host_of(url_col).alias("host")).withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    wrappers = induce_wrappers(own)
    kind = own.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = with_wrapper(own, wrappers)
    return joined.select("page_id", "url", "html", "skeleton", "template", "content").mapInArrow(run, f"page_id {kind}, url string, text string")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


#: The same for the given pages, whose articles hold headings, paragraphs, breaks and bold text only.
OP2_SQL = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(regexp_replace(t, '&amp;?', '&', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '\s+', ' ', 'g')) AS text FROM (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM pages))
"""
