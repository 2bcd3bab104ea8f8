"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments (three for 4 bits) that two
fingerprints within reach differ by at most one bit in one of them.  For each
segment the index holds its value as it is, and with each bit left out in turn.
Fingerprints that share an entry are compared; those that are near are linked,
and the links' connected components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, let_go, small_enough, table, texts_of, written
from .components import connected_components

SHINGLE, MAX_BITS = 4, 4
#: Fingerprints of one index entry that one task compares at once; a larger
#: entry is cut into blocks, and each pair of blocks is compared by itself.
BLOCK = 4096
#: Entries up to this size are compared pair by pair, larger ones by search.
FEW = 64
#: Parts of a segment, one of which is left out, in an index whose entries are made in tasks.
PARTS = 4

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP = 1 << 16


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words; of fewer words, of all of them."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[j:] for j in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.array([digest(b" ".join(x), 42) for x in runs], np.uint64)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned; 0 without words.  Repeated shingles count each time."""
    words = word_list(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros((8, 8), np.int64)
    for k in range(0, n, _STEP):  # a very long text goes in parts
        h = shingle_hashes(words[k : k + _STEP + shingle - 1] if len(words) >= shingle else words, shingle)
        own = h.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            ones[b] += np.bincount(own[:, b], minlength=256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segments(max_bits: int) -> list[int]:
    """Masks of the segments: so few that one of them holds at most one of ``max_bits`` differences."""
    n = max_bits // 2 + 1
    at = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]


def variants(max_bits: int) -> list[int]:
    """For each index entry of a fingerprint the bits it holds: whole segments, then segments less one bit."""
    whole = segments(max_bits)
    return whole + [s & ~(1 << b) for s in whole for b in range(64) if s >> b & 1]


def index_entries(rows: DataFrame, max_bits: int, block: int, carried: tuple[str, ...] = ("fp",)) -> DataFrame:
    """``key`` and the ``carried`` columns: the index of ``fp``, with large entries cut into pairs of blocks.

    The lowest 7 bits of a key say which variant it is.  How many share a whole
    segment tells where an entry can be large; those are few, so the counts
    needn't be taken of all variants.  Rows are dealt to blocks by a hash of all
    that they carry, so that rows of one fingerprint are spread as well.
    """
    masks, n = variants(max_bits), len(segments(max_bits))
    key = lambda *c: F.xxhash64(*c).bitwiseAND(~127).bitwiseOR(F.col("pos").cast("long"))
    entries = lambda df: df.select("*", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("pos", "held"))
    whole = rows.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks[:n]))).alias("seg", "value"))
    large = written(whole.groupBy("seg", "value").count().where(F.col("count") > block // 2), "large")
    out = entries(rows).select(key("pos", "held").alias("key"), *carried)
    if large.isEmpty():
        return out
    held = entries(large.withColumnRenamed("value", "fp")).where(F.expr("pos = seg") | F.expr(" OR ".join(f"(seg = {s} AND pos IN ({','.join(str(p) for p in range(n, len(masks)) if masks[p] & masks[s])}))" for s in range(n))))
    cut = held.groupBy(key("pos", "held").alias("key")).agg(F.ceil((F.sum("count") + block // 2) / block).cast("int").alias("blocks"))
    return in_blocks(out.join(small_enough(written(cut, "cut")), "key", "left"), carried)


def in_blocks(joined: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """``key`` and the ``carried`` columns, with a key of several ``blocks`` (null: one) for each pair of them."""
    own = F.pmod(F.xxhash64(*carried, F.lit("block")), F.col("blocks")).cast("int")
    small = joined.where("blocks IS NULL OR blocks < 2").select("key", *carried)
    wide = joined.where("blocks > 1").withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block"))
    pos = F.col("key").bitwiseAND(127)
    pair = F.xxhash64("key", F.least("own", "other_block"), F.greatest("own", "other_block")).bitwiseAND(~127).bitwiseOR(pos)
    return small.unionByName(wide.select(pair.alias("key"), *carried))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, or of rows of several."""
    d = np.bitwise_count(x ^ y)
    return d if d.ndim < 2 or x.shape[-1] == 1 else d.sum(axis=-1, dtype=np.int64)


def first_shared(x: np.ndarray, pos: np.ndarray, masks: list[int], max_bits: int) -> np.ndarray:
    """Whether a pair, of the differences ``x``, meets in variant ``pos`` and in none before."""
    whole, bits = np.array(masks[: max_bits // 2 + 1], np.uint64), np.array(masks, np.uint64)
    seg = np.argmax(np.bitwise_count(x[:, None] & whole) <= 1, axis=1)
    inside = x & whole[seg]
    return np.where(inside == 0, pos == seg, (pos >= len(whole)) & ((bits[pos] | inside) == whole[seg]))


def forest(rows: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold together what is linked among many rows: a search that leaves out what it has reached.

    It starts from the least row by what it holds, so that in all entries the
    same rows are in the middle.
    """
    rest, a, b = np.lexsort(rows.T), [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop(0)
            near = distance(rows[rest], rows[x][None]).reshape(len(rest)) <= reach
            if near.any():
                new, rest = rest[near], rest[~near]
                a.append(np.full(len(new), x))
                b.append(new)
                front.extend(new)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_pairs(keys: np.ndarray, rows: np.ndarray, masks: list[int], max_bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of near rows that share a key, from rows sorted by key; the first column is what the index holds.

    A pair is given under the first variant it shares only.  In an entry of few
    rows, with no more near pairs than rows, all of them are given, in others a
    forest of them.  That holds all together: what a forest leaves out is linked
    by it, and a pair of the forest that isn't given has met before.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    entry = np.repeat(np.arange(len(sizes)), sizes)
    few = sizes[entry] <= FEW
    none = np.zeros(0, np.int64)
    a, b = [none], [none]
    for d in range(1, int(min(FEW, sizes.max(initial=1)))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & few[d:])
        if not len(i):
            break
        i = i[distance(rows[i], rows[i + d]).reshape(len(i)) <= reach]
        a.append(i)
        b.append(i + d)
    a, b = np.concatenate(a), np.concatenate(b)
    dense = (sizes > FEW) | (np.bincount(entry[a], minlength=len(sizes)) > sizes)
    a, b = [a[~dense[entry[a]]]], [b[~dense[entry[a]]]]
    for s, n in zip(starts[dense], sizes[dense], strict=True):
        x, y = forest(rows[s : s + n], reach)
        a.append(s + x)
        b.append(s + y)
    a, b = np.concatenate(a), np.concatenate(b)
    first = first_shared(rows[a, 0] ^ rows[b, 0], (keys[a] & 127).astype(np.int64), masks, max_bits)
    return a[first], b[first]


def parted_entries(rows: DataFrame, max_bits: int, block: int, carried: tuple[str, ...] = ("fp",)) -> DataFrame:
    """``key`` and the ``carried`` columns: fewer rows than ``index_entries`` has, from which tasks make its entries by ``opened``.

    A segment is cut into ``PARTS`` parts.  Segments that differ in one bit at
    most are equal but for one part, so a row goes out once for each part that is
    left out, where the index has one for each bit that is.  The lowest 7 bits of
    a key say which segment and part.  A key has all rows of some whole segments;
    those that many rows have tell which keys are to be cut into pairs of blocks.
    """
    whole, kept = segments(max_bits), parts(max_bits)
    held = lambda masks: F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))
    key = lambda *c: F.xxhash64(*c).bitwiseAND(~127).bitwiseOR(F.col("pos").cast("long"))
    out = rows.select("*", F.posexplode(held(kept)).alias("pos", "held")).select(key("pos", "held").alias("key"), *carried)
    values = 1 << max(b - a for a, b in part_bits(max_bits))  # whole segments of a key
    counts = rows.select(F.posexplode(held(whole)).alias("seg", "value")).groupBy("seg", "value").count()
    large = written(counts.where(F.col("count") > block // (2 * values)), "large")
    if large.isEmpty():
        return out
    own = large.withColumnRenamed("value", "fp").select("*", F.posexplode(held(kept)).alias("pos", "held")).where(F.floor(F.col("pos") / PARTS) == F.col("seg"))
    cut = own.groupBy(key("pos", "held").alias("key")).agg(F.ceil((F.sum("count") + block // 2) / block).cast("int").alias("blocks")).where("blocks > 1")
    return in_blocks(out.join(small_enough(written(cut, "cut")), "key", "left"), carried)


def part_bits(max_bits: int) -> list[tuple[int, int]]:
    """First and last bit (exclusive) of each part of each segment."""
    n = max_bits // 2 + 1
    ends = [(64 * k // n, 64 * (k + 1) // n) for k in range(n)]
    return [(a + (b - a) * q // PARTS, a + (b - a) * (q + 1) // PARTS) for a, b in ends for q in range(PARTS)]


def parts(max_bits: int) -> list[int]:
    """For each segment, and each of its parts, the bits of the segment without that part."""
    return [s & ~((1 << b) - (1 << a)) for (a, b), s in zip(part_bits(max_bits), (s for s in segments(max_bits) for _ in range(PARTS)), strict=True)]


def opened(keys: np.ndarray, rows: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries of the index, each once, from rows of ``parted_entries``: of the part that is left out, all bits but one."""
    masks, n = variants(max_bits), len(segments(max_bits))
    at = {m: k for k, m in enumerate(masks)}
    pos, out, own = keys & 127, [], []
    for p, (a, b) in enumerate(part_bits(max_bits)):
        mine = np.flatnonzero(pos == p)
        whole = masks[p // PARTS]
        for m in [*([whole] if p % PARTS == 0 else []), *(whole & ~(1 << bit) for bit in range(a, b))]:
            with np.errstate(over="ignore"):
                h = (keys[mine].view(np.uint64) ^ (rows[mine, 0] & np.uint64(m))) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((h ^ (h >> np.uint64(32))) & np.uint64(~127 & (1 << 64) - 1) | np.uint64(at[m]))
            own.append(mine)
    found, own = np.concatenate(out).view(np.int64), np.concatenate(own)
    order = np.argsort(found, kind="stable")
    return found[order], rows[own[order]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, others: tuple[str, ...] = (), reach: int | None = None, parted: bool = False) -> DataFrame:
    """Near fingerprints of a table of distinct ``fp``, enough to connect all that are linked.

    Gives ``a`` and ``b``.  Fingerprints are linked at ``reach`` differing bits
    or fewer (``max_bits`` unless it is given) if they share an entry, which all
    do within ``max_bits``.  With ``others``, columns of further fingerprints,
    the bits of all are counted, and ``a_..`` and ``b_..`` are given for each.
    If ``parted``, the same entries are made in the tasks, from fewer rows.
    """
    masks, cols = variants(max_bits), ("fp", *others)
    reach = max_bits if reach is None else reach
    names = [x for side in "ab" for x in (side, *(f"{side}_{c}" for c in others))]
    at_once = 1 << (16 if parted else 18)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        keys, own = np.zeros(0, np.int64), np.zeros((0, len(cols)), np.uint64)

        def out(k: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            if parted:
                k, rows = opened(k, rows, max_bits)
            found = near_pairs(k, rows, masks, max_bits, reach)
            return pa.RecordBatch.from_arrays([pa.array(rows[i, c].view(np.int64)) for i in found for c in range(len(cols))], names)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            own = np.concatenate([own, np.stack([batch.column(1 + c).to_numpy().view(np.uint64) for c in range(len(cols))], axis=1)])
            if len(keys) < at_once:
                continue
            cut = np.searchsorted(keys, keys[-1])  # the last entry may go on in the next batch
            yield out(keys[:cut], own[:cut])
            keys, own = keys[cut:], own[cut:]
        if len(keys):
            yield out(keys, own)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = (parted_entries if parted else index_entries)(fps, max_bits, block, cols)
    return entries.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the least id that links reach) for each row of ``docs``.

    Null and empty texts, and those of white space, have fingerprint 0, which is
    linked like any other.  Copies share a fingerprint, so a group of copies of
    any size is one entry of the index.  Rows that repeat an id count as rows of
    their own; a null id is never a group's id unless all its ids are null.
    Other columns are ignored; an empty table gives no rows.
    """
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = written(connected_components(links(distinct.select("fp"), max_bits, block)), "roots")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    linked = written(linked, "linked")
    least = written(linked.groupBy("root").agg(F.min("least_id").alias("group_id"), F.count(F.lit(1)).alias("fps")), "least")
    group = join_hot(linked, least, ["root"], "fps").select("fp", "group_id")
    labels = written(distinct.join(group, "fp", "left").select("fp", F.coalesce("group_id", "least_id").alias("component_id"), "copies"), "labels")
    return join_hot(own, labels, ["fp"], "copies").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
