"""Near copies of texts: similar sets of word shingles, found by deletion-variant SimHash signatures.

A text's set of five-word shingles has several fingerprints, each with its own
hashes.  The index of ``simhash`` meets two texts if, in one of the fingerprints,
one of four segments differs by at most one bit; of those, texts within
``REACH`` bits of two fingerprints together are compared by their whole sets.
At a similarity of 0.8 a bit differs with probability 0.152, so a segment of 16
bits differs by one bit at most with probability 0.28, one of four does with
0.73, and one of twelve, in three fingerprints, with 0.98.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_ids, join_hot, keep_ids, let_go, texts_of, written
from .components import connected_components
from .simhash import distance, links, shingle_hashes, word_list

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a text, bits that the index reaches for certain (which gives
#: four segments), and bits of two fingerprints within which sets are compared:
#: at a similarity of 0.8 these have 19.4 differing bits, with a deviation of 4.
SEEDS, MAX_BITS, REACH = 3, 7, 30
#: Fingerprints of one key of the index that go to one task; more are cut into pairs of blocks.
BLOCK_ROWS = 1 << 14
#: Shingles of the documents of a group that a task compares with each other at
#: once; a larger group is cut into blocks, each pair of which is compared by itself.
BLOCK_SHINGLES = 1 << 17
_STEP = 1 << 14


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending; none without words."""
    words = word_list(text)
    return np.unique(shingle_hashes(words, shingle)) if words else np.zeros(0, np.uint64)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same shingles; seed 0 leaves them as they are."""
    if not seed:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signatures(hashes: np.ndarray, seeds: int = SEEDS) -> list[int]:
    """Fingerprints of a set of hashes, unsigned, one for each seed; 0 for an empty set."""
    out = []
    for s in range(seeds):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), _STEP):
            own = np.unpackbits(mixed(hashes[k : k + _STEP], s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += own.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little"))
    return out


def near_units(docs: DataFrame, id_col: str, text_col: str, shingle: int, seeds: int) -> tuple[DataFrame, DataFrame]:
    """One document for each set of shingles, with its fingerprints; and ``a``, ``b``: it and each other one of that set."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"fp{s}" for s in range(seeds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            same, fps = [], []
            for x in b.column(1):
                h = shingle_set(x.as_py(), shingle)
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(signatures(h, seeds))
            fps = np.array(fps, np.uint64).reshape(-1, seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), *(pa.array(fps[:, s]) for s in range(seeds))], ["doc_id", "same", *names])

    rows = texts_of(docs, id_col, text_col).where("doc_id IS NOT NULL")
    own = written(rows.mapInArrow(run, f"doc_id {kind}, same binary, " + ", ".join(f"{x} long" for x in names)), "signatures")
    units = written(own.groupBy("same", *names).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "units")
    copies = join_hot(own.select("doc_id", "same"), units.where("copies > 1").select("same", "first", "copies"), ["same"], "copies").where("doc_id != first")
    return units.select(F.col("first").alias("doc_id"), *names), written(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "same")


def near_links(own: DataFrame, seeds: int, max_bits: int, reach: int) -> DataFrame:
    """``a`` and ``b``: documents that the index meets, enough to connect all that it does."""
    found = None
    for s in range(seeds):
        mine = own.select("doc_id", F.col(f"fp{s}").alias("fp"), F.col(f"fp{(s + 1) % seeds}").alias("beside"))
        first = written(mine.groupBy("fp", "beside").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "first")
        same = join_hot(mine, first.where("copies > 1"), ["fp", "beside"], "copies").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
        near = written(links(first.select("fp", "beside"), max_bits, BLOCK_ROWS, ("beside",), reach, parted=True), "near")
        end = lambda side, name: first.select(F.col("fp").alias(side), F.col("beside").alias(f"{side}_beside"), F.col("first").alias(name))  # noqa: B023, E731
        ends = near.join(end("a", "x"), ["a", "a_beside"]).join(end("b", "y"), ["b", "b_beside"])
        more = same.union(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
        found = more if found is None else found.union(more)
    # each pair once, whichever way round; the way round is kept, as ``a`` is in the middle of many
    return found.where("a != b").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).dropDuplicates(["lo", "hi"]).select("a", "b")


def undecided(own: DataFrame, near: DataFrame, sound: DataFrame) -> DataFrame:
    """The rows of ``own`` in groups (``near``: ``node``, ``root``) that verified links leave in parts.

    Adds ``root``, ``members`` (how many rows the group has) and ``part``.
    """
    part = connected_components(sound).select(F.col("node").alias("doc_id"), F.col("root").alias("part"))
    rows = near.select(F.col("node").alias("doc_id"), "root").join(part, "doc_id", "left").select("doc_id", "root", F.coalesce("part", "doc_id").alias("part"))
    parts = written(rows, "parts")
    sizes = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("size"))
    # two that are near have been compared; of three, some may not have been
    left = sizes.groupBy("root").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("members")).where("parts > 1 AND members > 2")
    return own.join(join_hot(parts, written(left.select("root", "members"), "open"), ["root"], "members"), "doc_id")


def settle(ids: pa.Array, sides: np.ndarray, fps: np.ndarray, parts: list, sets: list[np.ndarray], reach: int, similarity: float) -> tuple[list[int], list[int]]:
    """Places of pairs that join parts: of similar documents within ``reach`` of each other, one of either side.

    Those in the middle come first, so that a part grows soon; what a part
    already has isn't compared again.
    """
    n = len(ids)
    names = {p: k for k, p in enumerate(dict.fromkeys(parts))}
    comp = np.array([names[p] for p in parts])
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    at = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)

    def apart(k: int) -> np.ndarray:
        d = np.bitwise_count(fps ^ fps[k]).astype(np.int64)
        return np.min([d[:, s] + d[:, (s + 1) % fps.shape[1]] for s in range(fps.shape[1])], axis=0)

    far = np.sum([np.minimum(apart(k), reach + 1) for k in np.linspace(0, n - 1, min(n, 64)).astype(int)], axis=0)
    a, b = [], []
    for k in np.argsort(far, kind="stable"):
        other = sides != sides[k] if sides.any() else np.ones(n, bool)
        like = (sizes >= similarity * sizes[k]) & (sizes[k] >= similarity * sizes)
        j = np.flatnonzero(other & like & (comp != comp[k]) & (apart(k) <= reach))
        if not len(j):
            continue
        mine = flat[at[k] : at[k + 1]]
        mark[mine] = True
        common = np.array([np.count_nonzero(mark[flat[at[x] : at[x + 1]]]) for x in j])
        mark[mine] = False
        for x in j[common >= similarity * (sizes[j] + sizes[k] - common)]:
            if comp[x] != comp[k]:
                comp[comp == comp[x]] = comp[k]
                a.append(int(k))
                b.append(int(x))
    return a, b


def settled(left: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, seeds: int, reach: int, similarity: float) -> DataFrame:
    """``a`` and ``b``: similar documents of different parts of a group, enough to join all parts that are similar.

    The documents of a group meet with their sets, block by block; a task looks
    at every pair of two blocks that is within reach and not in one part yet,
    and gives at most one pair for each document.  A set goes once to each block
    of its group, so what is shuffled grows as the square of a group that is
    left in parts, divided by the size of a block.
    """
    kind = left.schema["doc_id"].dataType.simpleString()
    left = written(left, "undecided")
    sets = written(shingle_sets(docs, left.select("doc_id"), id_col, text_col, shingle), "sets")
    rows = written(left.join(sets, "doc_id"), "members")
    blocks = rows.groupBy("root").agg(F.ceil(F.sum(F.size("grams") + 16) / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
    rows = join_hot(rows.drop("members"), written(blocks, "blocks"), ["root"], "members")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") > F.col("other"), 1).when(F.col("own") < F.col("other"), -1).otherwise(0)
    names = [f"fp{s}" for s in range(seeds)]
    rows = rows.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "doc_id", "part", side.alias("side"), *names, "grams")

    def compare(found: pa.Table) -> pa.RecordBatch:
        ids = found.column("doc_id").combine_chunks()
        fps = np.stack([found.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
        grams = found.column("grams").combine_chunks()
        sets = [x.values.to_numpy() for x in grams]
        a, b = settle(ids, found.column("side").to_numpy(), fps, found.column("part").to_pylist(), sets, reach, similarity)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
            if held and held[0].column("pair")[0].as_py() != pairs[0]:
                yield compare(pa.concat_tables(held))
                held = []
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(pairs)], strict=True):
                held.append(pa.Table.from_batches([batch.slice(int(s), int(e - s))]))
                if e < len(pairs):
                    yield compare(pa.concat_tables(held))
                    held = []
        if held:
            yield compare(pa.concat_tables(held))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(run, f"a {kind}, b {kind}")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id`` and ``grams``, the set of shingle hashes, of the documents that ``ids`` names; a row for each set of an id."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in b.column(1)]
            same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "same", "grams"])

    texts = keep_ids(texts_of(docs, id_col, text_col), ids, "doc_id")
    return texts.mapInArrow(run, f"doc_id {kind}, same binary, grams array<long>").dropDuplicates(["doc_id", "same"]).drop("same")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets of word shingles have at least the given Jaccard similarity.

    Shingles are compared by 64-bit hashes.  A pair takes the set of its ``b``
    to where the set of ``a`` is, so that what is in the middle of many pairs
    isn't copied for each.
    """
    ends = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends")
    grams = written(shingle_sets(docs, ends, id_col, text_col, shingle), "grams")
    both = pairs.join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b").join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where((union == 0) | (common >= F.lit(similarity) * union)).select("a", "b").distinct()  # an id may have several sets


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, seeds: int = SEEDS, max_bits: int = MAX_BITS, reach: int = REACH) -> DataFrame:
    """``node`` and ``class_id`` (the least id) of every document that is similar to another.

    Documents are linked if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more; classes are what links connect.  Documents of
    equal sets are one to begin with.  The index gives pairs enough to hold
    together what it meets.  Where the check of similarity leaves such a group
    in parts, its documents are compared across the parts, until all pairs
    within reach are checked or in one part.  So no link that the index meets
    is lost.

    Null and empty texts, and those of white space, have an empty set and are
    copies of each other; a text of fewer than five words is one shingle.  Rows
    without an id aren't looked at; rows that repeat an id with different texts
    are one document that has the links of all of them.  Other columns are
    ignored; an empty table gives no rows.
    """
    units, same = near_units(docs, id_col, text_col, shingle, seeds)
    met = written(near_links(units, seeds, max_bits, reach), "pairs")
    near = written(connected_components(met), "near")
    sound = written(verified(met, docs, id_col, text_col, shingle, similarity), "sound")
    left = undecided(units, near, sound)
    sound = sound.union(written(settled(left, docs, id_col, text_col, shingle, seeds, reach, similarity), "settled"))
    roots = written(connected_components(sound.union(same)), "roots")
    least = written(roots.groupBy("root").agg(F.min("node").alias("class_id"), F.count(F.lit(1)).alias("size")), "least")
    return join_hot(roots, least, ["root"], "size").select("node", "class_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have the least id of their class (``near_classes``), with all their columns.

    Rows without an id stay; rows that repeat an id stay or go together.
    """
    gone = near_classes(docs, id_col, text_col, **options).where("node != class_id").select(F.col("node").alias(id_col))
    return drop_ids(docs, written(gone, "gone"), id_col)
