"""SimHash groups and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagesift.llm.components import connected_components
from pagesift.llm.near_copies import SEEDS, drop_near_copies, near_classes, shingle_set, signatures
from pagesift.llm.simhash import fingerprint, links, near_groups, near_pairs, segments, signed, variants


def plain_fingerprint(text, n=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    runs = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups_of(fps, max_bits):
    """Component of each fingerprint by comparing all pairs."""
    at = list(range(len(fps)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= max_bits:
                x, y = find(i), find(j)
                at[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "A b\x0bC", "Ä B c d e f", "a  b c d a b c d a b c d", "é x y\x1cz w v", "w " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_segments_leave_one_bit_at_most():
    for bits in range(1, 9):
        masks = segments(bits)
        assert sum(masks) == (1 << 64) - 1 and bits // len(masks) <= 1
        assert len(variants(bits)) == 64 + len(masks)


@pytest.mark.parametrize(("max_bits", "block"), [(4, 4096), (4, 60), (2, 4096), (3, 40)])
def test_groups(spark, max_bits, block):
    r = random.Random(max_bits * block)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = {r.getrandbits(64) for _ in range(200)} | {0}
    for c in centres:
        for _ in range(250):
            x = c
            for _ in range(r.randrange(8)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(links(df, max_bits, block)).collect()}
    want, seen = groups_of(fps, max_bits), {}
    for x, g in zip(fps, want, strict=True):
        own = roots.get(signed(x), signed(x))
        assert seen.setdefault(g, own) == own
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("max_bits", "block"), [(7, 4096), (7, 60), (4, 60), (3, 40)])
def test_an_index_whose_entries_are_made_in_tasks(spark, max_bits, block):
    """A quarter of the rows, and the same links."""
    from pagesift.llm.simhash import PARTS, index_entries, parted_entries

    r = random.Random(max_bits + block)
    fps = {r.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for c in [r.getrandbits(64) for _ in range(4)]:
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(9))) for _ in range(250)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(links(df, max_bits, block, parted=True)).collect()}
    want, seen = groups_of(fps, max_bits), {}
    for x, g in zip(fps, want, strict=True):
        assert seen.setdefault(g, roots.get(signed(x), signed(x))) == roots.get(signed(x), signed(x))
    assert len(set(seen.values())) == len(seen)
    if block == 4096:
        n = len(segments(max_bits))
        assert parted_entries(df, max_bits, block).count() == n * PARTS * len(fps) < index_entries(df, max_bits, block).count() // 4
        pairs = [{(x.a, x.b) for x in links(df, max_bits, block, parted=p).collect()} for p in (False, True)]
        assert pairs[0] == pairs[1] and pairs[0]


def test_near_links_sends_a_quarter_of_the_index(spark, monkeypatch):
    from pagesift.llm import near_copies, simhash

    sent = []
    for name in ("index_entries", "parted_entries"):
        monkeypatch.setattr(simhash, name, lambda *a, f=getattr(simhash, name, None): sent.append(f(*a)) or sent[-1])
    r = random.Random(3)
    own = spark.createDataFrame([(k, *(signed(r.getrandbits(64)) for _ in range(SEEDS))) for k in range(300)], "doc_id long, fp0 long, fp1 long, fp2 long")
    near_copies.near_links(own, SEEDS, near_copies.MAX_BITS, near_copies.REACH)
    assert len(sent) == SEEDS and sum(x.count() for x in sent) <= 16 * SEEDS * 300


def test_a_worker_keeps_one_thing_only():
    import weakref

    import public_tokenizers
    from pagesift.llm import common
    from pagesift.llm.piece_codec import codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    held = weakref.ref(codec(path))
    assert codec(path) is held() is not None
    common.kept("other", dict)
    assert held() is None
    held = weakref.ref(codec(path))
    common.let_go()
    assert held() is None


def test_what_a_task_holds_in_a_cycle_is_let_go():
    import gc
    import weakref

    import public_tokenizers

    from pagesift.llm import common
    from pagesift.llm.piece_codec import codec

    task = {"own": codec(public_tokenizers.path("piece_bpe_32k.model"))}
    task["task"], held = task, weakref.ref(task["own"])
    del task
    gc.disable()  # as if it weren't due yet
    try:
        common.let_go()
        assert held() is None
    finally:
        gc.enable()


def test_near_documents(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randrange(1, 5) for _ in range(300)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split()
        w[r.randrange(300)] = "changed"
        rows += [(100 + k, " ".join(w)), (200 + k, t.upper())]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (303, "one"), (None, "one"), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = near_groups(docs.repartition(3)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = groups_of(fps, 4)
    least = {g: min((i for (i, _), h in zip(rows, groups, strict=True) if h == g and i is not None), default=None) for g in set(groups)}
    want = sorted(((i, signed(f), least[g]) for (i, _), f, g in zip(rows, fps, groups, strict=True)), key=str)
    assert sorted(((x.doc_id, x.fp, x.component_id) for x in got), key=str) == want
    kept = drop_near_copies(docs)
    # one changed word of 300 leaves a similarity of 0.97; texts without words are one group
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {*range(20), 300, 303, None}
    assert drop_near_copies(docs.limit(0)).count() == 0
    assert near_groups(docs.limit(0)).count() == 0


def similar(a, b):
    a, b = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def classes_of(texts):
    """Least place of each text's class, by comparing all pairs."""
    sets = [frozenset(shingle_set(t).tolist()) for t in texts]
    at = list(range(len(texts)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (common := len(a & b)) >= 0.8 * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                at[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def words_by(r):
    return lambda: "".join(r.choice("abcdefgh") for _ in range(5))


@pytest.mark.parametrize("length", [180, 400])
def test_recall_against_brute_force(spark, length):
    """Pairs of texts at 0.78 to 0.95: none below 0.8 is dropped; of those above, nine tenths and more are at every level."""
    r = random.Random(length)
    word = words_by(r)
    rows, at = [], []
    for k in range(1500):
        w = [word() for _ in range(length)]
        v = list(w)
        aim = r.uniform(0.78, 0.95)
        while aim < similar(" ".join(w), " ".join(v)):
            v[r.randrange(length)] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        at.append(similar(rows[-1][1], rows[-2][1]))
    kept = {x.doc_id for x in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(2 * k in kept for k in range(1500)) and all(2 * k + 1 in kept for k in range(1500) if at[k] < 0.8)
    recall = {}
    for low, high in ((0.8, 0.83), (0.83, 0.87), (0.87, 0.96)):
        caught = [2 * k + 1 not in kept for k in range(1500) if low <= at[k] < high]
        recall[low] = sum(caught) / len(caught)
        assert len(caught) > 40 and recall[low] >= 0.9
    print(length, recall)


def test_a_large_group_of_copies_is_found_whole(spark):
    """Copies as near to a base as 0.8 to 0.9, but less near to each other."""
    r = random.Random(7)
    word = words_by(r)
    base = [word() for _ in range(400)]
    texts = []
    for _ in range(600):
        v = list(base)
        for at in r.sample(range(400), r.randrange(4, 9)):
            v[at] = word()
        texts.append(" ".join(v))
    texts.insert(200, " ".join(base))
    kept = {x.doc_id for x in drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    want = set(classes_of(texts))
    assert kept == want


def test_near_but_not_similar_documents_lose_no_link(spark):
    """Texts of one template: the first tries fail, and pairs among the rest are similar."""
    r = random.Random(8)
    word = words_by(r)
    base, texts = [word() for _ in range(300)], []
    for _ in range(150):  # about 0.7 from each other
        v = list(base)
        for at in r.sample(range(300), 9):
            v[at] = word()
        texts += [" ".join(v), " ".join([*v[:-1], word()])]
    r.shuffle(texts)
    found = {x.node: x.class_id for x in near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    got = [found.get(k, k) for k in range(len(texts))]
    want = classes_of(texts)
    assert got == want


def test_texts_that_share_a_frequent_line(spark):
    """One line over and over, then words of their own: the line alone makes no copies, and hides none."""
    r = random.Random(9)
    word = words_by(r)
    line = " ".join(word() for _ in range(5))
    tails = [[word() for _ in range(200)] for _ in range(2)]
    texts = {1: tails[0], 2: tails[1], 3: [*tails[1][:-1], "other"]}
    docs = spark.createDataFrame([(k, f"{line} " * 300 + " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert {x.doc_id for x in drop_near_copies(docs).collect()} == {1, 2}


def test_links_of_equal_fingerprints_are_each_looked_at(spark, monkeypatch):
    """Signatures that don't tell texts apart change the work, not the result."""
    from pagesift.llm import near_copies

    monkeypatch.setattr(near_copies, "mixed", lambda h, seed: h * 0)
    r = random.Random(10)
    word = words_by(r)
    texts = []
    for _ in range(40):
        v = [word() for _ in range(60)]
        texts += [" ".join(v), " ".join([*v, word()])]
    r.shuffle(texts)
    units = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.node: x.class_id for x in near_classes(units.coalesce(1)).collect()}
    assert [found.get(k, k) for k in range(len(texts))] == classes_of(texts)


def test_signatures():
    h = shingle_set("a b c d e f g a b c d e")
    assert len(h) == 7 and shingle_set(" \n").tolist() == [] and len(shingle_set("one two")) == 1
    assert signatures(h)[0] == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > len(h))
    assert signatures(shingle_set(None)) == [0] * SEEDS
    many = np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert signatures(many)[0] == sum(1 << b for b in range(64) if int((many >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(many))


def test_long_chains(spark):
    n = 400
    edges = [(k, k + 1) for k in range(n)] + [(10_000 + k, 10_000) for k in range(1, 300)] + [(7_000, 7_000), (1, 0)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[k] for k in range(n + 1)}) == 1 and len({found[10_000 + k] for k in range(300)}) == 1 and found[0] != found[10_000]


def test_large_entries_give_a_forest():
    r = np.random.default_rng(1)
    fps = np.unique(np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(5), fps ^ np.uint64(9)]))
    a, b = near_pairs(np.zeros(len(fps), np.int64), fps[:, None], variants(4), 4, 4)
    assert len(a) < len(fps) and (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    words = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " more"), (3, words("b") + " more"), (4, words("c")), (5, words("c") + " x"), (6, words("d"))]
    for seed in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed * 3, "text")
        assert {x.node: x.class_id for x in near_classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
        assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 1, 4, 6]
