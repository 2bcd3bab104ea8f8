"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import spelling
from pagesift.llm.spelling import Cells, Tree, letter_counts, matrix, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, times=5):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return Counter(out)


def corpus():
    r = random.Random(5)
    base = ["".join(r.choice(("an", "er", "ti", "é", "on", "À", "ß", "st")) for _ in range(r.randint(3, 5))) for _ in range(120)]
    words = []
    for k, w in enumerate(base):
        words += [w] * (1 + 700 // (k + 1))
        for _ in range(3):
            at, c = r.randrange(len(w)), r.choice("aentöÿ")
            words += [r.choice((w[:at] + c + w[at + 1 :], w[:at] + c + w[at:], w[:at] + w[at + 1 :]))] * r.choice((1, 5, 6, 30))
    words += ["chainaa"] * 5 + ["chainab"] * 30 + ["chainbb"] * 160 + ["chainbbb"] * 900  # forms of forms
    words += ["tiedaaa"] * 50 + ["tiedaab"] * 50 + ["tiedaac"] * 9 + ["ababab"] * 9 + ["bababa"] * 9  # ties; the same letters otherwise
    words += ["x" * 3000] * 6 + ["x" * 2999 + "y"] * 5 + ["ABCdef×÷"] * 8
    r.shuffle(words)
    rows = [(k, r.choice((" ", ", ", "-", "1", "Ā", "　")).join(words[k * 9 : k * 9 + 9])) for k in range(len(words) // 9 + 1)]
    return rows + [(1, rows[1][1]), (None, rows[2][1]), (None, None), (5000, ""), (5001, " \n 12 ")]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word", "n", "cell", "form"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("cell_words", [16_000, 12])
def test_variants(spark, cell_words):
    rows = corpus()
    got = Counter(tuple(r) for r in variants(docs_of(spark, rows).repartition(3), cell_words=cell_words).select("word", "n", "n_near", "form", "form_n", "root").collect())
    want = plain(rows)
    assert got == want and len(want) > 200
    assert any(f and r != f for _, _, _, f, _, r in want) and any(len(w) > 2000 for w, *_ in want)


def test_no_words(spark):
    assert variants(docs_of(spark, [])).count() == 0
    assert variants(docs_of(spark, [(1, None), (2, ""), (3, "short")])).count() == 0


def test_tree_finds_all_pairs():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcé") for _ in range(7)) for _ in range(900)})
    points = [w.encode("latin-1") for w in words]
    tree = Tree(points, np.arange(len(points)), leaf=4)
    for n in (7, 6):
        asked = sorted({"".join(r.choice("abcéz") for _ in range(n)) for _ in range(300)})
        a, b = tree.near([w.encode("latin-1") for w in asked])
        assert Counter((asked[x], tree.words[y].decode("latin-1")) for x, y in zip(a, b, strict=True)) == Counter((x, y) for x in asked for y in words if one_edit(x, y))


def test_cells_reach_all_that_is_near():
    r = random.Random(4)
    words = [("".join(r.choice("abcdé") for _ in range(8))).encode("latin-1") for _ in range(500)]
    counts = letter_counts(matrix(words))
    cells = Cells.cut(counts[:100], 16)
    assert cells.cells == 16
    home = {int(k): c for c, rows in cells.reached(counts, 0, 0) for k in rows}
    assert len(home) == 500 and len(set(home.values())) > 8
    reached = {(int(k), c) for c, rows in cells.reached(counts, 1, 1) for k in rows}
    gap = counts[:, None, :].astype(int) - counts[None, :, :]
    near = (np.maximum(gap, 0).sum(axis=2) <= 1) & (np.maximum(-gap, 0).sum(axis=2) <= 1)
    assert all((int(a), home[int(b)]) in reached for a, b in zip(*np.nonzero(near), strict=True))
    assert len(reached) < 500 * 16


def test_tasks_hand_counts_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TASK_WORDS", 3)
    rows = corpus()[:60]
    got = {r.word: r.n for r in spelling.word_counts(docs_of(spark, rows)).collect()}
    assert got == {w: n for w, n, *_ in plain(rows)}
