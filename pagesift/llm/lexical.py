"""Ranked lexical search in K2-treaps, compressed quadtrees over the grid of terms and documents.

Documents are indexed in blocks.  A block's grid has a row for each term, the
frequent ones first, and a column for each document in order of ids; a cell's
value is the impact of the term in the document.  Bands of as many rows as there
are columns are cut into quarters again and again; a node keeps which quarters
hold something (four bits) and the greatest impact in it (rounded up), so all
children of a level stand in one array, found by counting bits.

A query follows the paths of its terms' rows down together.  A state is a range
of documents with the node of each row; its bound is the sum of the nodes'
maxima, weighted by term.  Ranges with the greatest bound are split first, and
those whose bound is below the best scores so far never are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, scratch_path, small_enough, table, texts_of, written

BEST = 50
#: Terms (with repeats) and documents that close a block; a longer document is a block of its own.
BLOCK_TERMS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Maxima are kept as multiples of so much, rounded up; an impact is less than 1,000,000.
STEP = 4000
#: Document ranges that are split at once.
SPLIT = 256
#: Rows (item, term) of queries that go to the tasks at once; more take several readings of the index.
QUERY_ROWS, BROADCAST_TERMS = 500_000, 300_000

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
#: Of a node's four bits: how many are set, and how many before each quarter.
_SET = np.array([m.bit_count() for m in range(16)], np.int64)
_BEFORE = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.int64)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_TERMS).split()


def spread_bits(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32 with a free place between each two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def norms(lengths: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """How much documents of these lengths weaken a term; in whole numbers of any size."""
    return np.array([50 + 50 * n * n_docs // n_terms for n in lengths], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // np.maximum(1, 1000 * tf + 20 * m)


class Treap:
    """The tree of a block: levels of nodes from the bands down, and how often the term stands in the document at the leaves."""

    def __init__(self, depth: int, masks: list[np.ndarray], tops: list[np.ndarray], tf: np.ndarray):
        end = lambda x: np.append(x, x.dtype.type(0))  # noqa: E731  place -1 stands for no node
        self.depth, self.tf = depth, end(tf)
        self.masks, self.tops = [end(x) for x in masks], [end(x) for x in tops]
        self.first = [end(np.cumsum(_SET[x]) - _SET[x]) for x in masks]

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Depth, masks and maxima of all levels, and leaves; of distinct cells."""
        depth = max(1, int(len(m) - 1).bit_length())
        low = np.uint64((1 << depth) - 1)
        rows = rows.astype(np.uint64)
        key = ((rows >> np.uint64(depth)) << np.uint64(2 * depth)) | (spread_bits(rows & low) << np.uint64(1)) | spread_bits(columns)
        order = np.argsort(key)
        key, leaves = key[order], tf[order]
        top = -(-impacts(leaves, m[columns[order]]) // STEP)
        masks, tops = [], []
        for _ in range(depth):
            up = key >> np.uint64(2)
            at = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (key & np.uint64(3)).astype(np.uint8), at))
            top = np.maximum.reduceat(top, at)
            tops.append(top.astype(np.uint8))
            key = up[at]
        return depth, masks[::-1], tops[::-1], leaves.astype(np.uint32)

    def split(self, d: int, rows: np.ndarray, node: np.ndarray, half: int) -> np.ndarray:
        """The rows' nodes on the next level, in one half of the documents of each range."""
        own = self.masks[d][node]
        quarter = 2 * ((rows >> (self.depth - 1 - d)) & 1) + half
        return np.where((own >> quarter) & 1, self.first[d][node] + _BEFORE[own, quarter], -1)


def best_in(treap: Treap, rows: np.ndarray, weights: np.ndarray, m: np.ndarray, floor: int, best: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns and scores of documents that may be among the best, and how many ranges were split.

    Documents with less than ``floor`` aren't; all others of the block's best
    are there, those with the same score as the last of them too.
    """
    node = (rows >> treap.depth)[None, :]
    bound = treap.tops[0][node].astype(np.int64) @ weights * STEP
    heap, turn, splits = [(-int(bound[0]), 0, 0, np.zeros(1, np.int64), node, bound)], 0, 0
    columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while heap and -heap[0][0] >= floor:
        _, _, d, column, node, bound = heapq.heappop(heap)
        live = bound >= floor
        column, node = column[live], node[live]
        splits += len(column)
        column = np.concatenate([2 * column, 2 * column + 1])
        node = np.concatenate([treap.split(d, rows, node, 0), treap.split(d, rows, node, 1)])
        if d + 1 < treap.depth:
            bound = treap.tops[d + 1][node].astype(np.int64) @ weights * STEP
        else:
            there = column < len(m)  # beyond the last document there is nothing
            column, node = column[there], node[there]
            bound = impacts(treap.tf[node], m[column][:, None]) @ weights
        live = bound >= floor
        column, node, bound = column[live], node[live], bound[live]
        if d + 1 == treap.depth:
            columns, scores = np.concatenate([columns, column]), np.concatenate([scores, bound])
            if len(scores) >= best:
                floor = max(floor, int(np.partition(scores, -best)[-best]))
                keep = scores >= floor
                columns, scores = columns[keep], scores[keep]
            continue
        order = np.argsort(-bound, kind="stable")
        for k in range(0, len(order), SPLIT):
            part = order[k : k + SPLIT]
            turn += 1
            heapq.heappush(heap, (-int(bound[part[0]]), turn, d + 1, column[part], node[part], bound[part]))
    return columns, scores, splits


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for x in b.column(0):
                k = len(terms_of(x.as_py()))
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def index_rows(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row for each block: ``ids`` and ``lengths`` of its documents, ``words`` with ``df`` in the block, and the tree.

    Every document with a term is in one block.  A task holds the terms of one
    block at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids", "lengths", "words", "df", "nodes", "masks", "tops", "tf"]

    def block(ids: list, id_type: pa.DataType, sizes: list[int], flat: list[int], vocabulary: dict[bytes, int]) -> pa.RecordBatch:
        by_id = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        lengths = [sizes[k] for k in by_id]
        cells, tf = np.unique(np.array(flat, np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
        term, column = cells // len(ids), cells % len(ids)
        df = np.bincount(term, minlength=len(vocabulary))
        words = list(vocabulary)
        order = sorted(range(len(words)), key=lambda k: (-df[k], words[k]))
        row = np.empty(len(words), np.int64)
        row[order] = np.arange(len(words))
        depth, masks, tops, leaves = Treap.build(row[term], column, tf, norms(lengths, n_docs, n_terms))
        assert depth == len(masks)
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[ids[k] for k in by_id]], pa.list_(id_type)), one(lengths, pa.list_(pa.int64())), one([words[k].decode() for k in order], pa.list_(pa.string())), one(df[order].tolist(), pa.list_(pa.int64())),
                one([len(x) for x in masks], pa.list_(pa.int64())), one(np.concatenate(masks).tobytes(), pa.binary()), one(np.concatenate(tops).tobytes(), pa.binary()), one(leaves.tobytes(), pa.binary()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, flat, vocabulary = [], [], [], {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                terms = terms_of(x.as_py())
                if not terms:
                    continue
                if ids and (len(flat) + len(terms) > block_terms or len(ids) >= BLOCK_DOCS):
                    yield block(ids, b.schema.field(0).type, sizes, flat, vocabulary)
                    ids, sizes, flat, vocabulary = [], [], [], {}
                ids.append(i)
                sizes.append(len(terms))
                flat.extend([vocabulary.setdefault(t, len(vocabulary)) for t in terms])
        if ids:
            yield block(ids, b.schema.field(0).type, sizes, flat, vocabulary)

    schema = f"ids array<{kind}>, lengths array<long>, words array<string>, df array<long>, nodes array<long>, masks binary, tops binary, tf binary"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, int, int]:
    """The written index of ``docs`` with how many documents and terms they have, which its impacts hold for.

    ``path`` is a folder that all executors see; by default one in the shared folder.
    A block is a row group of its own: readers hold a whole row group, and writers
    else look at the bytes of one after 100 rows only, whatever its size is to be.
    """
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs, text_col)
    rows = index_rows(docs, n_docs, max(1, n_terms), id_col, text_col, block_terms)
    path = path or scratch_path(spark, "treaps")
    rows.write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)
    return spark.read.schema(rows.schema).parquet(path), n_docs, n_terms


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id`` and ``term``, each pair once."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in enumerate(b.column(1)):
                found = sorted(set(terms_of(x.as_py())))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(found), b.column(0).type), pa.array([t.decode() for t in found], pa.string())], ["item_id", "term"])

    bounded_batches(items.sparkSession)
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


def search(index: DataFrame, n_docs: int, n_terms: int, items: DataFrame, item_col: str = "item_id", text_col: str = "text", best: int = BEST) -> DataFrame:
    """The ``best`` documents for each item: ``item_id``, ``rank``, ``doc_id`` and ``score``, above 0 only.

    ``index``, ``n_docs`` and ``n_terms`` are what ``build_index`` gives.  Equal
    scores are ranked by ascending id, those without an id last.  Rows that
    repeat an item's id are one item with the terms of all; so are items without
    an id.  Null texts and texts without terms find nothing, and nothing finds
    them.  Documents that repeat an id are ranked each by itself.  Other columns
    are ignored; empty tables give no rows.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    asked = written(query_terms(items, item_col, text_col), "query-terms")
    wanted = small_enough(asked.select("term").distinct(), BROADCAST_TERMS)
    known = index.select(F.explode(F.arrays_zip("words", "df")).alias("x")).select(F.col("x.words").alias("term"), F.col("x.df").alias("df"))
    df = known.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = written(asked.join(df, "term"), "weights")
    parts = max(1, math.ceil(weighed.count() / QUERY_ROWS))
    kind, id_kind = weighed.schema["item_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    item_type, doc_type = to_arrow_type(weighed.schema["item_id"].dataType), to_arrow_type(index.schema["ids"].dataType.elementType)
    found = None
    for part in range(parts):
        queries: dict = {}
        for r in weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect():
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
            if w > 0:
                queries.setdefault(r.item_id, ([], []))
                queries[r.item_id][0].append(r.term)
                queries[r.item_id][1].append(w)
        shared = spark.sparkContext.broadcast(list(queries.items()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = [(i, terms, np.array(weights, np.int64)) for i, (terms, weights) in shared.value]
            wanted = {t for _, terms, _ in asked for t in terms}
            tops: dict[int, list[tuple]] = {}
            by_id = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0)
            for b in batches:
                for k in range(b.num_rows):
                    ids, lengths, words, nodes = (b.column(b.schema.get_field_index(c))[k].values for c in ("ids", "lengths", "words", "nodes"))
                    masks, highs, tf = (np.frombuffer(b.column(b.schema.get_field_index(c))[k].as_py(), t) for c, t in (("masks", np.uint8), ("tops", np.uint8), ("tf", np.uint32)))
                    cuts = np.cumsum(nodes.to_numpy())[:-1]
                    treap = Treap(len(nodes), np.split(masks, cuts), np.split(highs, cuts), tf)
                    m = norms(lengths.to_pylist(), n_docs, n_terms)
                    row = {w: j for j, w in enumerate(words.to_pylist()) if w in wanted}
                    for q, (_, terms, weights) in enumerate(asked):
                        have = [j for j, t in enumerate(terms) if t in row]
                        if not have:
                            continue
                        mine = tops.setdefault(q, [])
                        floor = mine[-1][0] if len(mine) >= best else 1
                        columns, scores, _ = best_in(treap, np.array([row[terms[j]] for j in have], np.int64), weights[have], m, floor, best)
                        if len(columns):
                            mine += [(s, ids[c].as_py()) for s, c in zip(scores.tolist(), columns.tolist(), strict=True)]
                            mine.sort(key=by_id)
                            del mine[best:]
            for q, mine in tops.items():
                yield pa.RecordBatch.from_arrays([pa.array([asked[q][0]] * len(mine), item_type), pa.array([i for _, i in mine], doc_type), pa.array([s for s, _ in mine], pa.int64())], ["item_id", "doc_id", "score"])

        rows = index.select("ids", "lengths", "words", "nodes", "masks", "tops", "tf").mapInArrow(run, f"item_id {kind}, doc_id {id_kind}, score long")
        found = rows if found is None else found.unionByName(rows)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(*build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
g AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
x AS (SELECT r, doc_id, len(ts)::BIGINT AS size, unnest(ts) AS t FROM d),
p AS (SELECT r, doc_id, size, t, count(*) AS tf FROM x SEMI JOIN i USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, docs),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * docs) // terms))))::BIGINT AS score
  FROM i JOIN w USING (t) JOIN p USING (t), g GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""
