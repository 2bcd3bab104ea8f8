"""Quality rules in a cascade, against plain loops."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesift.llm.cascade import BASE, FEATURES, MORE, STATISTICS, Profile, Rule, Text, judged, profile, repeated_words

WORD = "[^\x20\x09-\x0d]+"
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b c a b c",
    "   x \x1c y\x85z",  # white space to others, not here
    "word " * 60,
    "many different words " + " ".join(f"w{k}" for k in range(60)),
    "\n".join(f"a line of words number {k}" for k in range(30)),
    "\n".join(["the same line again"] * 9 + [f"line {k} is another one" for k in range(5)]),
    " ".join(f"TOK{k}" for k in range(80)),
    " ".join(f"Ünï{k}§ÉÀ" for k in range(80)),
    " ".join(f"{k} |" for k in range(100)),
    " ".join(str(k * 7919) for k in range(100)),
    " ".join("x" * (20 + k % 9) + str(k) for k in range(70)),
    "😀 𝒳𝒴 word\n" * 3 + " ".join(f"v{k}" for k in range(60)),
    "# $ % & | < > *" * 20,
    " ".join(f"long text {k} of it" for k in range(40_000)),
]


def plain(text):
    t = text or ""
    words = re.findall(WORD, t)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + o for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for o in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines))
    letter = sum(any(unicodedata.category(c)[0] == "L" for c in w) for w in words)
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    failed = n < 50 or 100 * len(hit) > 50 * n
    kept = not failed and 2 * n <= chars <= 12 * n and 10 * symbols <= n and 2 * dup <= len(lines) and 2 * letter >= n and 5 * upper <= 2 * chars
    return n, chars, symbols, dup, len(hit), failed, kept


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_words", "kept", "words", "lang"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_statistics_and_verdicts(spark):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, TEXTS[7]), (7, TEXTS[7])]
    got = judged(docs_of(spark, rows).repartition(3), MORE, report=STATISTICS, first=BASE).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain(t)) for i, t in rows)
    assert len({r.kept for r in got}) == 2
    assert judged(docs_of(spark, []), MORE, report=STATISTICS, first=BASE).count() == 0


def test_all_rules_as_a_cascade_say_the_same(spark):
    """The order that a sample gives doesn't change a verdict, whatever the sample."""
    rows = list(enumerate(TEXTS)) * 3
    for sample in (0, 5, 1000):
        got = judged(docs_of(spark, rows), (*MORE, *BASE), sample_docs=sample).collect()
        assert Counter((r.doc_id, r.base_failed, r.kept) for r in got) == Counter((i, False, plain(t)[-1]) for i, t in rows)


def test_order_is_by_rejection_per_cost():
    rules = tuple(Rule(n, lambda get: False) for n in ("dear", "cheap", "idle", "with_dear"))
    found = Profile(Counter(a=10.0, b=1.0, c=1.0), {"dear": {"a"}, "cheap": {"b"}, "idle": {"c"}, "with_dear": {"a", "b"}}, Counter({frozenset({"dear", "with_dear"}): 30, frozenset({"cheap"}): 20, frozenset(): 50}))
    assert [r.name for r in found.order(rules, set())] == ["cheap", "dear", "with_dear", "idle"]
    assert found.order(rules, {"a"})[0].name == "dear"


def test_a_rule_stops_the_cascade(spark):
    """Dear features of texts that a cheap rule rejects are never worked out."""
    asked = []
    features = FEATURES | {"dear": lambda text, get: asked.append(text) or len(text)}
    text = Text("short", features)
    assert any(r.broken(text.get) for r in (BASE[0], Rule("dear", lambda get: get("dear") > 3))) and not asked
    found = profile(docs_of(spark, list(enumerate(TEXTS))), (*BASE, *MORE), FEATURES)
    assert sum(found.broken.values()) == len(TEXTS) and found.needs["repeated_windows"] == {"n_repeat_words", "n_words", "words"} and found.cost["kinds"] > 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 200])
def test_repeated_words(n):
    words = [b"%d" % (k * k % 7) for k in range(n)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    assert repeated_words(words) == len({k + o for k in range(n - 2) if windows[tuple(words[k : k + 3])] > 1 for o in range(3)})
