"""Ranked search against plain scoring of every document."""

import glob
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagesift.llm import lexical
from pagesift.llm.common import scratch_path
from pagesift.llm.lexical import Treap, best_in, build_index, impacts, norms, search, spread_bits

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def cut(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best=50):
    terms = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    N, L = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for item, ts in asked.items():
        rows = []
        for doc, c in terms:
            m = 50 + (50 * sum(c.values()) * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(rows, key=lambda x: x[:3])[:best], 1)]
    return Counter(out)


def corpus(n=700):
    r = random.Random(8)
    words = [f"w{k}é" if k % 5 == 0 else f"w{k}" for k in range(400)]
    draw = lambda k: " ".join(words[min(399, int(r.expovariate(0.02)))] for _ in range(k))
    docs = [(k * 3 % n, draw(r.choice((1, 5, 40, 200)))) for k in range(n)]
    docs += [(1000 + k, docs[5][1]) for k in range(80)]  # more copies than places: ties
    docs += [(5, docs[9][1]), (5, docs[9][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "! ?"), (2003, "W3 w3. W3-w3" * 400), (2004, "日本語 w1_w2")]
    items = [("a", docs[5][1]), ("b", "W1 w2; w399 nowhere"), ("c", None), ("d", "!"), ("e", draw(60)), ("f", "w1"), ("f", "w2"), (None, "日本語"), ("g", "nowhere"), ("h", "w0é W3")]
    return docs, items


def frames(spark, docs, items):
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for name in ("score", "rank", "term", "ids", "df"):
        d, q = d.withColumn(name, F.lit("clash")), q.withColumn(name, F.lit("clash"))
    return d.repartition(3, "text"), q


@pytest.mark.parametrize("block_terms", [1 << 20, 2000, 1])
def test_search(spark, block_terms):
    docs, items = corpus()
    d, q = frames(spark, docs, items)
    got = Counter(tuple(r) for r in search(*build_index(d, block_terms=block_terms), q).collect())
    assert got == plain(docs, items)


def test_queries_in_parts_and_other_sizes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_ROWS", 40)
    docs, items = corpus(300)
    d, q = frames(spark, docs, items)
    at = scratch_path(spark, "index")
    index = build_index(d, at)
    for best in (1, 7):
        assert Counter(tuple(r) for r in search(*index, q, best=best).collect()) == plain(docs, items, best)
    again = spark.read.parquet(at)  # a written index is used again
    assert search(again, *index[1:], q).count() == search(*index, q).count() > 0


def test_a_block_is_read_by_itself(spark):
    """Memory doesn't follow how many blocks a task writes or reads: each is a row group."""
    at = scratch_path(spark, "index")
    index, *_ = build_index(frames(spark, *corpus(300))[0].coalesce(1), at, block_terms=2000)
    files = [pq.ParquetFile(x).metadata for x in glob.glob(f"{at.removeprefix('file:')}/*.parquet")]
    assert len(files) == 1 and files[0].num_row_groups == files[0].num_rows == index.count() > 5


def test_nothing(spark):
    docs, items = corpus(20)
    for a, b in (([], items), (docs, []), ([], []), ([(1, None), (2, "?")], items)):
        assert search(*build_index(frames(spark, a, b)[0]), frames(spark, a, b)[1]).count() == 0


def test_tree_skips_what_cannot_be_best():
    r = np.random.default_rng(2)
    n, v = 3000, 500
    cells = np.unique(np.minimum(v - 1, r.exponential(60, 60_000).astype(np.int64)) * n + r.integers(0, n, 60_000))
    rows, columns, tf = cells // n, cells % n, r.integers(1, 9, len(cells))
    m = norms(r.integers(10, 400, n).tolist(), n, 200 * n)
    treap = Treap(*Treap.build(rows, columns, tf, m))
    dense = np.zeros((v, n), np.int64)
    dense[rows, columns] = impacts(tf, m[columns])
    for _ in range(20):
        ask, weights = r.choice(v, 12, replace=False), r.integers(1, 9000, 12)
        want = weights @ dense[ask]
        got_columns, got, splits = best_in(treap, ask, weights, m, 1, 50)
        last = np.sort(want)[-50]
        assert dict(zip(got_columns.tolist(), got.tolist(), strict=True)) == {c: want[c] for c in np.flatnonzero(want >= max(1, last)).tolist()}
        assert splits < 2 * n
    rare = int(rows.max())
    _, found, splits = best_in(treap, np.array([rare, 0]), np.array([9000, 1]), m, 9000 * 300_000, 50)
    assert splits < 400


def test_spread_bits():
    for x in (0, 1, 5, 1023, 65535, (1 << 32) - 1):
        assert int(spread_bits(np.array([x]))[0]) == sum(((x >> k) & 1) << (2 * k) for k in range(32))
