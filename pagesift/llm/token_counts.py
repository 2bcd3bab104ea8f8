"""Token counts by a two-tier lookup on the map side.

A text is cut at blanks, tabs and line ends.  The tokenizer never joins two of
these pieces (its pre-tokens hold no white space, and neither normalisation nor
an added token reaches across a blank), so a text's count is the sum of its
pieces' counts.  Pieces are looked up first in a broadcast table of frequent
pieces, then in a cache that each Python worker keeps, and only then encoded.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of

#: Bounds of the broadcast table: documents drawn for it from all of the table,
#: pieces that each may name, and pieces held.  The table decides speed only:
#: what isn't in it is encoded exactly, so no result depends on these figures.
TABLE_DOCS, DOC_PIECES, TABLE_SIZE = 2_000, 1_000, 50_000
#: Entries in a worker's cache before it starts anew (about 150 bytes each), and the longest piece it holds.
CACHE_SIZE, CACHE_CHARS = 300_000, 64

#: A word and the marks after it: two pre-tokens for the tokenizer.  Its lower-casing
#: of these letters is Python's, and none of the marks joins a letter.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")

_worker: dict = {}


def pieces(text: str) -> list[str]:
    """The text cut at blanks, tabs and line ends; some pieces may be empty."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def lengths(tokenizer, found: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]


class Lookup:
    """Counts of one worker: the broadcast table, then its own cache, then the tokenizer."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer = load_tokenizer(path)
        #: Ids of pieces that end a word; none in a vocabulary without word ends.
        self.ends = np.array(sorted(i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")))
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Counts of a batch of texts; pieces that neither tier has are encoded together."""
        frequent, cache, out, waiting = self.frequent, self.cache, [], []
        for k, text in enumerate(texts):
            total = 0
            for x in pieces(text or ""):
                n = frequent.get(x)
                if n is None and (n := cache.get(x)) is None:
                    if x:
                        waiting.append((k, x))
                    continue
                total += n
            out.append(total)
            if len(waiting) > 50_000:
                self._settle(waiting, out)
        self._settle(waiting, out)
        return out

    def words(self, words: list[str]) -> list[int]:
        """Counts of words that are one pre-token each: encoded in one go and cut at the word ends."""
        if not len(self.ends):
            return lengths(self.tokenizer, words)
        out: list[int] = []
        for k in range(0, len(words), 2000):
            ids = np.array(self.tokenizer.encode(" ".join(words[k : k + 2000]), add_special_tokens=False).ids)
            out.extend(np.diff(np.flatnonzero(np.isin(ids, self.ends)), prepend=-1).tolist())
        return out

    def _settle(self, waiting: list[tuple[int, str]], out: list[int]) -> None:
        parts: dict[str, tuple[str, ...]] = {}
        for _, x in waiting:
            if x not in parts:
                m = WORD.fullmatch(x)
                parts[x] = (m[1].lower(), *filter(None, [m[2]])) if m else (x,)
        cache = self.cache
        new = {y for p in parts.values() for y in p if y not in cache}
        words = [y for y in new if y.isalpha() and WORD.fullmatch(y)]
        rest = list(new.difference(words))
        fresh = dict(zip(words, self.words(words), strict=True)) | dict(zip(rest, lengths(self.tokenizer, rest), strict=True))
        known = {x: sum(fresh[y] if y in fresh else cache[y] for y in p) for x, p in parts.items()}
        for k, x in waiting:
            out[k] += known[x]
        if len(cache) > CACHE_SIZE:
            cache.clear()
        cache.update((x, n) for found in (known, fresh) for x, n in found.items() if len(x) <= CACHE_CHARS)
        waiting.clear()


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """The pieces seen most often in documents drawn from all of the table, with their token counts.

    Tasks count the pieces of the documents that they draw; nothing is shuffled,
    and at most ``DOC_PIECES`` pieces of about ``TABLE_DOCS`` documents reach the
    driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for x in b.column(0):
                seen.update(dict(Counter(y for y in pieces(x.as_py()) if 0 < len(y) <= CACHE_CHARS).most_common(DOC_PIECES)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    share = min(1.0, TABLE_DOCS / max(1, docs.count()))
    drawn = docs.select(F.col(text_col).alias("text")).sample(share, seed=7).where("text IS NOT NULL")
    total: Counter = Counter()
    for piece, n in drawn.mapInArrow(run, "piece string, n long").collect():
        total[piece] += n
    words = [x for x, _ in total.most_common(TABLE_SIZE)]
    return dict(zip(words, lengths(load_tokenizer(path), words), strict=True)) if words else {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: dict[str, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes`` and ``n_tokens``.

    ``path`` is a tokenizer file that every worker can open.  A null text counts
    as empty and has 0 bytes and 0 tokens, and so has a text of white space but
    for its bytes.  Special strings inside texts count as the tokenizer takes
    them by default.  Repeated rows each give a row; other columns are ignored.
    """
    spark = docs.sparkSession
    if frequent is None:
        frequent = frequent_lengths(docs, path, text_col)
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _worker.get((path, id(shared.value)))
        if lookup is None:
            _worker.clear()
            lookup = _worker[path, id(shared.value)] = Lookup(path, shared.value)
        for b in batches:
            counts = pa.array(lookup.count(x.as_py() for x in b.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts_of(docs, id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
