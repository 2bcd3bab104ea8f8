"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of ``window`` words has ``window - k + 1`` k-grams of words, and its
fingerprint is the leftmost one with the least hash.  As the window slides over a
text, a fingerprint is kept only where it isn't the one of the window before, so
few of a text's k-grams are.  Two equal windows have their fingerprint at the
same place within; a join on the hashes of fingerprints therefore meets every
shared window.  A hit is extended word by word to the left and to the right, as
far as any window with this fingerprint reaches, and counts if what is the same
is as long as a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, lower_ascii, small_enough, table, written

GRAM, WINDOW = 5, 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that one piece of a text has.
STRIDE = 8
#: Rows of benchmark fingerprints, and bytes of the words around them, that may be broadcast.
BROADCAST_RUNS, BROADCAST_BYTES = 200_000, 64 << 20


def words_of(text: Column) -> Column:
    """Words in ASCII lower case; none for a null text."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), NOT_WORD), ""), F.array().cast("array<string>"))


def winnowed(texts: DataFrame, k: int, length: int) -> DataFrame:
    """The fingerprints of texts: their columns without ``words``, ``block``, ``near``, ``j`` and ``hash``.

    A text is cut into overlapping pieces for ``STRIDE`` windows each, so that
    no row carries a whole text: ``near`` has the words of the piece, and the
    fingerprint is that of its window ``j``.  A word is hashed once, and a k-gram
    once in a piece, by compiled code that is short enough for the JVM.

    A window's fingerprint is new if the k-gram that has left was the least of
    the window before, or the one that came is less than all others.
    """
    n, pad = length - k + 1, max(1, length - k)  # k-grams of a window; words to the left of a piece's first window
    windows = F.size("words") - length + 1
    kept = [c for c in texts.columns if c != "words"]

    def piece(column: str, kind: str, b: Column) -> Column:
        """What a column has for a block of windows and around it, with nulls before the text's first word."""
        missing = F.greatest(F.lit(0), pad - b * STRIDE)
        own = F.slice(column, F.greatest(F.lit(1), b * STRIDE + 1 - pad), pad - missing + STRIDE + n + length - 2)
        return F.when(missing == 0, own).otherwise(F.concat(F.array_repeat(F.lit(None).cast(kind), missing), own))

    both = lambda b: F.struct(piece("words", "string", b).alias("near"), piece("hashes", "long", b).alias("hashes"))
    blocks = F.sequence(F.lit(0), F.floor((F.col("windows") - 1) / STRIDE).cast("int"))
    rows = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("windows", windows).where("windows > 0")
    rows = rows.select(*kept, "windows", F.posexplode(F.transform(blocks, both)).alias("block", "piece"))
    first, last = pad - 1, pad + STRIDE + n + k - 3
    rows = rows.select(*kept, "windows", "block", F.col("piece.near").alias("near"), *(F.coalesce(F.get("piece.hashes", F.lit(i)), F.lit(0)).alias(f"word{i}") for i in range(first, last + 1)))
    rows = rows.select(*kept, "windows", "block", "near", *(F.xxhash64(*(f"word{pad + i + x}" for x in range(k))).alias(f"gram{i + 1}") for i in range(-1, STRIDE + n - 1)))
    g = lambda i: F.col(f"gram{i + 1}")
    if n == 1:
        new = lambda j: F.struct(F.lit(j).alias("j"), g(j).alias("hash"))
    else:
        least = lambda j: F.least(*(g(i) for i in range(j, j + n - 1))) if n > 2 else g(j)
        rows = rows.select("*", *(least(j).alias(f"least{j}") for j in range(STRIDE)))
        isnew = lambda j: (F.col("block") * STRIDE + j == 0) | (g(j - 1) <= F.col(f"least{j}")) | (g(j + n - 1) < F.col(f"least{j}"))
        new = lambda j: F.when(isnew(j), F.struct(F.lit(j).alias("j"), F.least(f"least{j}", g(j + n - 1)).alias("hash")))
    prints = F.array(*(F.when(F.col("block") * STRIDE + j < F.col("windows"), new(j)) for j in range(STRIDE)))
    # an array of its own before it is exploded: within the generator it wouldn't be compiled
    rows = rows.select(*kept, "block", "near", prints.alias("prints"))
    return rows.select(*kept, "block", "near", F.explode(F.array_compact("prints")).alias("f")).select(*kept, "block", "near", "f.j", "f.hash")


def located(found: DataFrame, k: int, length: int) -> DataFrame:
    """Fingerprints with ``at``, the place of the k-gram (from 1), and ``here``.

    ``here`` has the words that a window with this k-gram can have, null beyond
    the text's ends.
    """
    n, pad = length - k + 1, max(1, length - k)
    rest = [c for c in found.columns if c not in ("block", "near", "j")]
    hashes = F.transform(F.slice("near", F.col("j") + (pad + 1), length), lambda w: F.xxhash64(w))
    rows = found.withColumn("hashes", hashes)
    gram = lambda i: F.xxhash64(*(F.get("hashes", F.lit(i + x)) for x in range(k)))
    place = reduce(lambda c, i: c.when(gram(i) == F.col("hash"), i), range(1, n), F.when(gram(0) == F.col("hash"), 0))
    rows = rows.withColumn("first", F.col("j") + place)
    here = F.slice("near", F.col("first") + (pad - (length - k) + 1), 2 * length - k)
    return rows.select(*rest, (F.col("block") * STRIDE + F.col("first") + 1).alias("at"), here.alias("here"))


def benchmark_runs(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``item``, ``words``, ``length``: what is looked for in an item of at least one word."""
    words = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    return words.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))


def shared_runs(docs: DataFrame, items: DataFrame, k: int, length: int) -> DataFrame:
    """``id``, ``tag``, ``start``, ``end``, ``item`` for what a document shares with an item, ``length`` words or more.

    ``docs`` has ``id``, ``tag`` and ``words``, ``items`` has ``item`` and ``words``.
    """
    kept = written(located(winnowed(items, k, length), k, length).select("item", "hash", F.col("here").alias("wanted")).distinct(), "fingerprints")
    size = kept.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("wanted", " "))), F.lit(0)).alias("bytes")).first()
    if size.rows <= BROADCAST_RUNS and size.bytes <= BROADCAST_BYTES:
        met = located(winnowed(docs, k, length).join(F.broadcast(kept), "hash"), k, length)
    else:  # hashes and places alone are shuffled, and the words of the documents met are joined back
        places = located(winnowed(docs, k, length).join(kept.select("hash").distinct(), "hash"), k, length).select("id", "tag", "at", "hash")
        places = places.groupBy(F.col("id").alias("id_"), F.col("tag").alias("tag_")).agg(F.collect_set(F.struct("at", "hash")).alias("places"))
        back = docs.dropDuplicates(["id", "tag"]).join(places, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")))
        beside = F.concat(F.array_repeat(F.lit(None).cast("string"), length - k), F.col("words"))
        here = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["hash"].alias("hash"), F.slice(beside, p["at"], 2 * length - k).alias("here")))
        met = back.select("id", "tag", F.explode(here).alias("p")).select("id", "tag", "p.*").join(kept, "hash")
    before = length - k  # words to the left that are compared
    same = [F.coalesce(F.get("here", F.lit(i)) == F.get("wanted", F.lit(i)), F.lit(False)) for i in range(before + length)]
    reach = lambda order: reduce(lambda found, x: found.when(~same[x[1]], x[0]), list(enumerate(order))[1:], F.when(~same[order[0]], 0)).otherwise(len(order)) if order else F.lit(0)
    spans = met.withColumn("l", reach(range(before - 1, -1, -1))).withColumn("r", reach(range(before, before + length)))
    spans = spans.where((F.col("r") >= k) & (F.col("l") + F.col("r") >= length))
    return spans.select("id", "tag", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r") - 1).alias("end"), "item")


def covered(spans: Column) -> Column:
    """How many places a sorted array of (start, end) covers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["end"] - F.greatest(acc["last"], x["start"] - 1))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["last"], x["end"]).alias("last"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """What each document shares with benchmark items.

    One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words
    inside a shared run), ``spans`` (stretches of shared runs, as word places
    from 1, which may overlap), ``items`` (ids of the items met, as sorted
    strings) and ``contaminated``.  A run has ``window`` words; an item of fewer
    words is one run.  Null and empty texts have no words and are clean; items
    without words meet nothing, and an item given twice counts once.  Each row
    has the hits of its own text, also where rows share an id or have none.
    Other columns are ignored; an empty table gives no rows.
    """
    wanted = written(benchmark_runs(items, item_col, item_text_col, window), "items")
    text = F.col(text_col)
    # rows of one id and text have the same hits, and others don't meet: two hashes tell an id's texts apart
    tag = F.struct(F.xxhash64(text), F.xxhash64(F.lit("tag"), text)).alias("tag")
    words = docs.select(F.col(id_col).alias("id"), tag, words_of(text).alias("words"))
    hits = None
    for (length,) in sorted(wanted.select("length").distinct().collect()):  # at most ``window`` rows
        more = shared_runs(words, wanted.where(F.col("length") == length).select("item", "words"), min(k, length), length)
        hits = more if hits is None else hits.unionByName(more)
    counted = docs.select(F.col(id_col).alias("doc_id"), tag, F.size(words_of(text)).cast("long").alias("n_words"))
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    if hits is None:
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none[0].alias("spans"), none[1].alias("items"), F.lit(False).alias("contaminated"))
    per = hits.groupBy("id", F.col("tag").alias("of")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    joined = counted.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no run with an item, with all their columns; rows without an id stay."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col).where("contaminated").select(F.col("doc_id").alias(id_col))
    return drop_ids(docs, written(found, "contaminated"), id_col)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0
), r AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS run FROM bs
), ds AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM r) WHERE len(w) >= n
), h AS (
  SELECT doc_id, s, ds.n, item_id FROM ds JOIN r ON r.n = ds.n AND r.run = array_to_string(w[s : s + ds.n - 1], ' ')
), p AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
