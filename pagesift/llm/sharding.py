"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A document's key is the hash of its text, so copies of a text start at one place
of the ring.  Walking clockwise, the next virtual node names its shard.  No shard
may hold more than ``1 + slack`` times the mean number of bytes: what doesn't fit
goes on clockwise to the next shard that has room.

Keys are placed heavy ones first.  A heavy key has more than ``slack / 4`` of a
shard's mean, so there are at most ``4 * shards / slack`` of them whatever the
input, and they are placed one by one.  All others are placed by arcs, the
stretches between virtual nodes: each arc's bytes are summed, the walk is done
over these sums, and a key follows from its place within its arc.
"""

from __future__ import annotations

import bisect
from collections import Counter
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, table, written

SHARDS, NODES, SLACK = 8, 128, 0.002
#: Buckets by which rows are numbered; their counts, one per shard and bucket, are summed in order.
BUCKETS = 1024
#: The ring is looked up by the leading bits of a point.
CELL_BITS = 12


class Ring(NamedTuple):
    points: list[int]  # of virtual nodes, ascending, as signed longs
    owner: list[int]

    @classmethod
    def make(cls, shards: int, nodes: int) -> Ring:
        at = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") - (1 << 63), s) for s in range(shards) for v in range(nodes))
        return cls([p for p, _ in at], [s for _, s in at])

    def arc(self, point: int) -> int:
        """The arc of a point, named by the virtual node at its clockwise end."""
        return bisect.bisect_left(self.points, point) % len(self.points)

    def cells(self) -> list[tuple[int, int, list[int]]]:
        """For each stretch of equal leading bits: its name, its first arc and the virtual nodes inside."""
        half, width = 1 << (CELL_BITS - 1), 1 << (64 - CELL_BITS)
        at = [bisect.bisect_left(self.points, c * width) for c in range(-half, half + 1)]
        return [(c, at[c + half], self.points[at[c + half] : at[c + half + 1]]) for c in range(-half, half)]


class Part(NamedTuple):
    """Of an arc or a heavy key, what lies from ``start`` on (in bytes) goes to ``shard``."""

    name: int
    start: int
    shard: int


def place(ring: Ring, shards: int, room: float, heavy: list[tuple[int, int, int]], arcs: dict[int, int]) -> tuple[list[Part], list[Part]]:
    """Parts of heavy keys and parts of arcs, so that no shard gets more than ``room``.

    ``heavy`` has (point, bytes, rows) of keys, ``arcs`` the bytes of each arc's
    other keys.  A heavy key stays whole if any shard has room for it, else it
    is cut between rows.
    """
    load, n = [0.0] * shards, len(ring.points)

    def walk(arc: int):
        seen = set()
        for k in range(n):
            s = ring.owner[(arc + k) % n]
            if s not in seen:
                seen.add(s)
                yield s
                if len(seen) == shards:
                    return

    whole, cut = [], []
    for point, size, rows in sorted(heavy, key=lambda x: (-x[1], x[0])):
        order = list(walk(ring.arc(point)))
        fit = next((s for s in order if load[s] + size <= room), None)
        if fit is not None:
            load[fit] += size
            whole.append(Part(point, 0, fit))
            continue
        each, done = size // rows, 0
        for s in order:
            take = min(rows - done, int(max(0.0, room - load[s]) // each))
            if take:
                whole.append(Part(point, done * each, s))
                load[s] += take * each
                done += take
        if done < rows:  # a row larger than what is left anywhere
            whole.append(Part(point, done * each, least := min(range(shards), key=load.__getitem__)))
            load[least] += (rows - done) * each
    left: list[tuple[int, int]] = []
    for arc in sorted(arcs):
        s, size = ring.owner[arc], arcs[arc]
        take = int(min(size, max(0.0, room - load[s])))
        if take:
            cut.append(Part(arc, 0, s))
            load[s] += take
        if take < size:
            left.append((arc, take))
    for arc, start in left:
        for s in walk(arc):
            take = int(min(arcs[arc] - start, max(0.0, room - load[s])))
            if take:
                cut.append(Part(arc, start, s))
                load[s] += take
                start += take
            if start == arcs[arc]:
                break
    return whole, cut


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within each value of ``by``, in the order of hash buckets and ids.

    Rows are numbered within a bucket, and a bucket starts after those before
    it, so that a value that most rows share is still dealt over the buckets.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy(by, "bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    offsets = counts.select(by, "bucket", before)
    within = F.row_number().over(W.partitionBy(by, "bucket").orderBy("doc_id", "row")) - 1
    return rows.withColumn("within", within).join(offsets, [by, "bucket"]).withColumn(name, F.col("before") + F.col("within")).drop("bucket", "within", "before")


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard for every row of ``docs``, near equal in bytes.

    One row per row of ``docs``: ``doc_id``, ``size`` (bytes of the text plus 1),
    ``text_crc32``, ``shard`` and ``slot`` (numbered from 0 within the shard).
    A shard holds at most ``1 + slack`` of the mean and the rest of one key.
    Copies of a text are together unless they are more than a shard has room
    for.  A null text has no bytes and is placed as an empty one.  Repeated rows
    and null ids are rows like any other.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("point"), F.monotonically_increasing_id().alias("row")),
        "rows",
    )
    ring = Ring.make(shards, nodes)
    keys = rows.groupBy("point").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    cells = F.broadcast(spark.createDataFrame(ring.cells(), "cell long, first int, inside array<long>"))
    arc = F.pmod(F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("point"))), F.lit(len(ring.points))).cast("int")
    keys = written(keys.withColumn("cell", F.shiftright("point", 64 - CELL_BITS)).join(cells, "cell").select("point", "bytes", "n", arc.alias("arc")), "keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    mean = total / shards
    is_heavy = F.col("bytes") > mean * slack / 4
    heavy = [tuple(r) for r in keys.where(is_heavy).select("point", "bytes", "n").collect()]  # at most 4 * shards / slack
    light = keys.where(~is_heavy)
    arcs = {r.arc: r.bytes for r in light.groupBy("arc").agg(F.sum("bytes").alias("bytes")).collect()}  # shards * nodes at most
    whole, cut = place(ring, shards, mean * (1 + slack), heavy, arcs)

    def parts(found: list[Part], key: str) -> DataFrame:
        """One row per key: where its parts start and the shard of each; as many rows as heavy keys or arcs."""
        by: dict[int, list[Part]] = {}
        for p in found:
            by.setdefault(p.name, []).append(p)
        made = [(k, [p.start for p in v], [p.shard for p in v]) for k, v in by.items()]
        return F.broadcast(spark.createDataFrame(made, f"{key} long, starts array<long>, to array<int>"))

    def pick(at):
        """The shard of the last part that starts at or before ``at``."""
        return F.element_at("to", F.greatest(F.lit(1), F.size(F.filter("starts", lambda s: s <= at))))

    offset = F.sum("bytes").over(W.partitionBy("arc").orderBy("point")) - F.col("bytes")
    placed = light.withColumn("offset", offset).join(parts(cut, "arc"), "arc").select("point", pick(F.col("offset")).alias("shard"), "n")
    times = Counter(p.name for p in whole)
    simple = keys.join(parts([p for p in whole if times[p.name] == 1], "point"), "point").select("point", F.element_at("to", 1).alias("shard"), "n")
    split = [p for p in whole if times[p.name] > 1]
    names = F.broadcast(spark.createDataFrame([(p,) for p in {p.name for p in split}], "point long"))
    sides = written(placed.unionByName(simple), "sides")
    out = join_hot(rows.join(names, "point", "left_anti"), sides, ["point"], "n").drop("n")
    if split:
        ranked = numbered(rows.join(names, "point", "left_semi"), "point", "rank")
        out = out.unionByName(ranked.join(parts(split, "point"), "point").withColumn("shard", pick(F.col("rank") * F.col("size"))).select(out.columns))
    return numbered(written(out, "placed"), "shard", "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
