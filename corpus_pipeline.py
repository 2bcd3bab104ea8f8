"""A corpus from raw documents to tokens, in five stages.

Each stage gets what the one before has written and reads all of it: the
quality classifier drops documents, exact and near deduplication keep one
document of each group, decontamination drops documents that hold benchmark
passages, and what remains is encoded.

Rows without an id stay to the end, as nothing can name them; of rows that repeat
an id and a text one stays, and else they go together wherever one of them goes.
Null and empty texts, and those of white space, are scored like any other; they
are copies of each other, of which one stays, hold no passage and have no tokens.
Texts are read whole at any length.  Columns beyond those of ``documents`` go
through unread.  No documents give no rows; without labels nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import table, written
from pagesift.llm.decontaminate import drop_contaminated
from pagesift.llm.exact_dedup import deduplicate
from pagesift.llm.piece_codec import encode
from pagesift.llm.quality import keep_good
from pagesift.llm.near_copies import drop_near_copies

MODEL = "piece_bpe_32k.model"
#: Words and pairs of pieces in a worker's caches: fewer than by themselves, as executors have run all other stages before.
WORDS, PAIRS = 40_000, 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints of five-word shingles."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of words with a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, and digests of the ids and of the text that they decode to."""
    return encode(docs, public_tokenizers.path(MODEL), digests=True, words=WORDS, pairs=PAIRS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


#: The classifier and the fingerprints have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
