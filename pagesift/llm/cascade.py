"""Quality rules as a cascade that stops at the first rule that a text breaks.

Rules read features of a text, and features may read others; each is worked out
once for a text, and only when a rule asks for it.  On a bounded sample the cost
of every feature is timed and the rules that every text breaks are noted.  Rules
are then put in order: next comes the one that rejects most of the sample's texts
that are left for the time of the features it still needs.  The order changes how
long a text takes, never whether it stays.
"""

from __future__ import annotations

import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of

#: Whole documents, drawn from all of the table, on which rules are timed.  They
#: decide the order of rules and nothing else.
SAMPLE_DOCS = 1000

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
SPACE, SYMBOL, LETTER, UPPER, CHAR_CHUNK = 1, 2, 4, 8, 1 << 20


@cache
def char_kinds() -> np.ndarray:
    """What each code point is: white space, a symbol, a letter, an upper-case letter."""
    kinds = np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        c = unicodedata.category(chr(k))
        kinds[k] = LETTER * (c[0] == "L") | UPPER * (c == "Lu")
    kinds[[ord(c) for c in SPACES]] |= SPACE
    kinds[[ord(c) for c in SYMBOLS]] |= SYMBOL
    return kinds


Get = Callable[[str], object]
#: A feature of a text; it may ask for others by name.
Feature = Callable[[str, Get], object]


def kinds_of(text: str, get: Get) -> np.ndarray:
    """The kind of each character, by parts, so that code points of a long text aren't all held at once."""
    parts = (text[k : k + CHAR_CHUNK] for k in range(0, len(text), CHAR_CHUNK))
    return np.concatenate([np.zeros(0, np.uint8), *(char_kinds()[np.frombuffer(p.encode("utf-32-le"), "<u4")] for p in parts)])


def words_of(text: str, get: Get) -> list[bytes]:
    return text.encode().split()  # of bytes, which is by the six ASCII characters of white space


def lines_of(text: str, get: Get) -> list[str]:
    """The lines that have a word."""
    return [x for x in text.split("\n") if x.strip(SPACES)]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in windows of so many words that the text has twice or more."""
    if len(words) <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    keys, n = ids[: 1 - width], len(names)
    for k in range(1, width):  # one number for each distinct window, however many words there are
        if k > 1 and n * len(names) >= 1 << 62:
            _, keys = np.unique(keys, return_inverse=True)
            n = int(keys.max()) + 1
        keys = keys * len(names) + ids[k : len(ids) - width + 1 + k]
        n *= len(names)
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[k : len(hit) - width + 1 + k] |= twice
    return int(hit.sum())


def alphabetic_words(kinds: np.ndarray) -> int:
    """Words with a letter."""
    inside = (kinds & SPACE) == 0
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    return int(np.count_nonzero(np.maximum.reduceat(kinds & LETTER, starts))) if len(starts) else 0


FEATURES: dict[str, Feature] = {
    "words": words_of,
    "lines": lines_of,
    "kinds": kinds_of,
    "n_words": lambda text, get: len(get("words")),
    "word_chars": lambda text, get: len(text) - sum(map(text.count, SPACES)),
    "n_symbols": lambda text, get: sum(map(text.count, SYMBOLS)),
    "n_lines": lambda text, get: len(get("lines")),
    "n_dup_lines": lambda text, get: len(get("lines")) - len(set(get("lines"))),
    "n_repeat_words": lambda text, get: repeated_words(get("words")),
    "n_alphabetic": lambda text, get: alphabetic_words(get("kinds")),
    "n_upper": lambda text, get: int(np.count_nonzero(get("kinds") & UPPER)),
}


@dataclass(frozen=True)
class Rule:
    """A text breaks the rule if ``broken`` holds for its features."""

    name: str
    broken: Callable[[Get], bool]


#: Rules that the base verdict has.
BASE = (
    Rule("few_words", lambda get: get("n_words") < 50),
    Rule("repeated_windows", lambda get: 100 * get("n_repeat_words") > 50 * get("n_words")),
)
#: Rules of the usual kind for web text: words of odd length, symbols, repeated
#: lines, words without letters, capitals.
MORE = (
    Rule("short_or_long_words", lambda get: not 2 * get("n_words") <= get("word_chars") <= 12 * get("n_words")),
    Rule("symbols", lambda get: 10 * get("n_symbols") > get("n_words")),
    Rule("repeated_lines", lambda get: 2 * get("n_dup_lines") > get("n_lines")),
    Rule("no_letters", lambda get: 2 * get("n_alphabetic") < get("n_words")),
    Rule("capitals", lambda get: 5 * get("n_upper") > 2 * get("word_chars")),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """The features of a text, each worked out when it is first asked for; ``cost`` has the seconds of each by itself."""

    def __init__(self, text: str, features: dict[str, Feature], timed: bool = False):
        self.text, self.features, self.known = text, features, {}
        self.timed, self.cost, self.inner = timed, {}, 0.0

    def get(self, name: str):
        if name not in self.known:
            if not self.timed:
                self.known[name] = self.features[name](self.text, self.get)
            else:
                before, self.inner, began = self.inner, 0.0, time.perf_counter()
                self.known[name] = self.features[name](self.text, self.get)
                took = time.perf_counter() - began
                self.cost[name] = took - self.inner
                self.inner = before + took
        return self.known[name]


@dataclass
class Profile:
    """Of a sample: seconds of each feature, features of each rule, and how many texts break just these rules."""

    cost: Counter
    needs: dict[str, set[str]]
    broken: Counter

    def order(self, rules: tuple[Rule, ...], known: set[str]) -> list[Rule]:
        """Rules by rejection per cost among the texts that those before them leave; ``known`` features cost nothing."""
        texts = max(1, sum(self.broken.values()))
        left, rest, out, known = Counter(self.broken), list(rules), [], set(known)
        while rest:
            def worth(r: Rule) -> tuple[float, float]:
                seconds = 1e-7 + sum(self.cost[f] for f in self.needs.get(r.name, set()) - known) / texts
                rejected = sum(n for names, n in left.items() if r.name in names)
                return rejected / seconds, -seconds

            best = max(rest, key=worth)
            rest.remove(best)
            out.append(best)
            known |= self.needs.get(best.name, set())
            left = Counter({names: n for names, n in left.items() if best.name not in names})
        return out


def profile(docs: DataFrame, rules: tuple[Rule, ...], features: dict[str, Feature], text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Profile:
    """Time the features and try every rule on about ``sample_docs`` whole documents.

    A task gives one row for each set of rules that some text breaks, for each
    feature and for each rule's features, so the driver gets little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, needs, broken = Counter(), {}, Counter()
        char_kinds()
        for b in batches:
            for x in b.column(0):
                text, mine = x.as_py() or "", []
                whole = Text(text, features, timed=True)
                for r in rules:
                    asked: set[str] = set()

                    def get(name: str, asked=asked, whole=whole):
                        asked.add(name)
                        return whole.get(name)

                    mine += [r.name] * bool(r.broken(get))
                    needs.setdefault(r.name, set()).update(asked)
                cost.update(whole.cost)
                broken["\t".join(mine)] += 1
        deep = {r: closure(asked, features) for r, asked in needs.items()}
        rows = [("cost", k, v) for k, v in cost.items()] + [("needs", f"{r}\t{f}", 1.0) for r, fs in deep.items() for f in fs] + [("broken", k, float(v)) for k, v in broken.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["what", "name", "value"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    found = docs.select(text_col).sample(share, seed=11).mapInArrow(run, "what string, name string, value double").groupBy("what", "name").agg(F.sum("value").alias("value")).collect()
    out = Profile(Counter(), {}, Counter())
    for what, name, value in found:
        if what == "cost":
            out.cost[name] = value
        elif what == "needs":
            rule, feature = name.split("\t")
            out.needs.setdefault(rule, set()).add(feature)
        else:
            out.broken[frozenset(filter(None, name.split("\t")))] += int(value)
    return out


def closure(asked: set[str], features: dict[str, Feature]) -> set[str]:
    """Features, and those that they read in turn, told by asking each with a short text."""
    done: set[str] = set()
    todo = list(asked)
    while todo:
        name = todo.pop()
        if name not in done:
            done.add(name)
            probe = Text("probe", features)
            probe.get(name)
            todo += [f for f in probe.known if f not in done]
    return done


def judged(docs: DataFrame, rules: tuple[Rule, ...], *, report: tuple[str, ...] = (), first: tuple[Rule, ...] = (), features: dict[str, Feature] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the ``report`` features, ``base_failed`` and ``kept``.

    Features in ``report`` (integers) are worked out for every text, so rules
    that read only these cost next to nothing.  ``first`` are rules that come
    before the cascade; ``base_failed`` tells if one of them is broken.  A text
    stays if it breaks none of ``first`` nor of ``rules``.

    Null and empty texts, and those of white space, have no words and break what
    a text of no words breaks.  Texts are read whole.  Repeated rows each give a
    row; other columns are ignored; an empty table gives no rows.
    """
    features = features or FEATURES
    for_rules = profile(docs, (*first, *rules), features, text_col, sample_docs)
    known = closure(set(report), features)
    if first:  # what the rules before it read is known where the cascade begins
        known |= {f for r in first for f in for_rules.needs.get(r.name, set())}
        left = {names: n for names, n in for_rules.broken.items() if not names & {r.name for r in first}}
        for_rules = Profile(for_rules.cost, for_rules.needs, Counter(left))
    ordered = for_rules.order(tuple(rules), known)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(len(report) + 2)]
            for x in b.column(1):
                get = Text(x.as_py() or "", features).get
                for c, name in zip(out, report, strict=False):
                    c.append(get(name))
                failed = any(r.broken(get) for r in first)
                out[-2].append(failed)
                out[-1].append(not failed and not any(r.broken(get) for r in ordered))
            arrays = [pa.array(c, pa.int64()) for c in out[:-2]] + [pa.array(c, pa.bool_()) for c in out[-2:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", *report, "base_failed", "kept"])

    schema = f"doc_id {kind}, " + "".join(f"{x} long, " for x in report) + "base_failed boolean, kept boolean"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), MORE, report=STATISTICS, first=BASE)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS k FROM w),
win AS (SELECT r, k, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY k)),
tri AS (SELECT r, k, count(*) OVER (PARTITION BY r, a, b, c) AS c FROM win WHERE c IS NOT NULL),
hit AS (SELECT r, count(DISTINCT k + o) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
f AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\pL')))::BIGINT AS n_alphabetic,
    length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM d JOIN w USING (r) LEFT JOIN hit USING (r)
),
g AS (SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 2 * n_alphabetic >= n_words AND 5 * n_upper <= 2 * word_chars AS kept
FROM g
"""
