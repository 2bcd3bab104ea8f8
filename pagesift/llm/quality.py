"""Text quality: ridge regression on random Fourier features of document statistics.

Cosines of random projections stand for a Gaussian kernel over the statistics.
Every task sums the normal equations of its rows; the sums are added up by
matrix row, and the small system is solved on the driver.  Isotonic regression
turns raw scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, let_go, table, texts_of, written

#: Random features, kernel width in standard deviations, ridge, and bins of raw scores.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-2, 2000
SEED = 7

_GROUPS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": (32, 9),
    "line": (10, 13),
    "stop": (33, 46, 63),
    "pause": (44, 58, 59),
    "quote": (34, 39, 40, 41, 45, 91, 93),
    "bar": (124,),
    "sign": (35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126),
    "control": (*range(9), 11, 12, *range(14, 32), 127),
    "other": range(128, 256),
}
_SUMS = np.zeros((256, len(_GROUPS)))
for _k, _codes in enumerate(_GROUPS.values()):
    _SUMS[list(_codes), _k] = 1
N_STATS = len(_GROUPS) + 13


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text: lengths, shares of kinds of characters, and repetition."""
    text = text or ""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    p = counts[counts > 0] / size
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    top = seen.most_common(1)[0][1] / n if seen else 0.0
    h = -sum(c * math.log(c / n) for c in seen.values()) / n
    ends = sum(x[-1] in ".!?" for x in words) / n
    return [
        *((counts @ _SUMS) / size).tolist(),
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        float(lengths.mean()) if len(lengths) else 0.0,
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        float((lengths <= 3).mean()),
        len(seen) / n,
        pairs,
        top,
        h,
        ends,
        len(set(lines)) / len(lines) - float((p * np.log(p)).sum()) / 10,
    ]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(x.as_py()) for x in b.column(1)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    features: int = FEATURES
    width: float = WIDTH

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / self.width, (len(self.mean), self.features))
        phase = rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((stats - self.mean) / self.std, -4, 4)  # nothing lies far from what was seen
        return np.hstack([np.cos(z @ w + phase) * math.sqrt(2 / self.features), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of the raw score's order stays, so that ties are few."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return 0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-4 * (raw - 0.5)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means ``y`` with weights ``n``, as knots to interpolate between."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """A model from all rows of ``stats`` and ``y`` (0 or 1); without rows every score is 0.5.

    A task sends its sums, half a megabyte, for some hundred thousand rows (a
    row has 200 bytes here); calibration is fitted on the same rows.
    """
    spark = rows.sparkSession
    sums = rows.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("k").collect()
    if not sums:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model(np.array([r.m for r in sums]), np.array([max(r.s, 1e-3) for r in sums]), features=features, width=width)
    width_ = features + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width_, width_ + 2))
        for b in batches:
            z, y = model.expand(matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            total[:, :width_] += z.T @ z
            total[:, width_] += z.T @ y
            total[0, width_ + 1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(range(width_), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["k", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["k", "v"])

    parts = rows.select("stats", "y").mapInArrow(partial, "k int, v binary").repartition(8, "k").mapInArrow(added, "k int, v binary").collect()
    total = np.zeros((width_, width_ + 2))
    for k, v in parts:
        total[k] = np.frombuffer(v)
    n = total[0, width_ + 1]
    model.weights = np.linalg.solve(total[:, :width_] + ridge * max(1.0, n / 1000) * np.eye(width_), total[:, width_])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.round((np.clip(model.raw(matrix(b.column(0))), -0.5, 1.5) + 0.5) * BINS / 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], ["bin", "y"])

    bins = rows.select("stats", F.col("y").cast("double").alias("y")).mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    x, y, w = (np.array([r[k] for r in bins], float) for k in range(3))
    model.knots = pool_adjacent(x * 2 / BINS - 0.5, y, w)
    return model


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a document's labels are kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality``; null labels, and those of
    documents with crc32(doc_id) mod 3 = 1, teach nothing.  All other labelled
    documents are used; one that is labelled twice counts as bad if one of its
    labels says so.  Null and empty texts are described by zeros and scored like
    any other; without labels every score is 0.5.  Repeated rows each give a
    row, and each teaches; other columns are ignored; an empty table gives no
    rows.
    """
    stats = written(described(docs, id_col, text_col), "stats")
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y")).where("y IS NOT NULL").groupBy("label_id").agg(F.min("y").alias("y"))
    train = written(stats.where(~held_out("doc_id", 3, 1)).join(known, F.col("doc_id") == F.col("label_id")).select("stats", "y"), "train")
    model = fit(train)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(matrix(b.column(1))))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't scored below 0.5, with all their columns; rows without an id stay."""
    scores = written(quality_scores(docs, labels, id_col, text_col), "quality")
    return drop_ids(docs, scores.where("predicted = 0").select(F.col("doc_id").alias(id_col)), id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
