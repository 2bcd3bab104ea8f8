"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of two rows of a hashed table, one of the word and
one of its first letters.  Filters over one, two and three words run over the
whole text; the strongest answer of each filter goes into a logistic layer.  The
model is fitted on whole texts of a bounded sample of labelled documents.  The
decision threshold is set for each language, which is told from the text itself,
on all other labelled documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, texts_of, written
from .quality import held_out

#: Rows of the embedding table, its width, filters of each width, and filter widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 8, (1, 2, 3)
STEM = 4
#: The sample to fit on: labelled documents of each class, and bytes of all their texts together.
FIT_ROWS, FIT_BYTES = 2_000, 32 << 20
#: Logits are counted in bins, so many to one, up to a bound on either side.
BINS, BOUND = 64, 100
#: Documents of each class that a language needs for a threshold of its own.
LANGUAGE_ROWS = 30
#: Passes over the sample: so many that it is seen SHOWN times in all, within bounds.
EPOCHS, SHOWN, BATCH, RATE, SEED = (5, 25), 40_000, 32, 0.1, 11
THRESHOLD = 0.3
#: Rows of the embedding table that fewer documents of the sample name stay zero, so that no document is learnt by its rarest words.
LEAST_DOCS = 5
WORDS_KEPT = 200_000
STEP = 1 << 16

WORD = re.compile(r"[^\W\d_]+")
#: Frequent words of each language, in public use for telling languages apart.
COMMON = {
    "en": "the of and to in is that it with for was on as are be by this from at".split(),
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine für".split(),
    "fr": "le la les des et est dans que pour qui par sur pas au une avec un du".split(),
    "es": "el los las del que y en una por con para es un se al como su más".split(),
}
LANGUAGES = (*COMMON, "other")
_OF = {}
for _k, _words in enumerate(COMMON.values()):
    for _w in _words:
        _OF.setdefault(_w, []).append(_k)


def word_ids(word: str) -> int:
    """Both table rows of a word, as one number."""
    return (zlib.crc32(word.encode()) % BUCKETS) << 20 | zlib.crc32(b"^" + word[:STEM].encode()) % BUCKETS


def language(words: list[str]) -> int:
    """Index of the language whose frequent words a text has most of; the last one if it has none."""
    counts = [0] * len(COMMON)
    for w in words:
        for k in _OF.get(w, ()):
            counts[k] += 1
    return counts.index(max(counts)) if any(counts) else len(COMMON)


def columns(width: int, k: int) -> slice:
    """Columns of the filter matrix for the k-th word of the filters of a width."""
    start = FILTERS * (sum(w for w in WIDTHS if w < width) + k)
    return slice(start, start + FILTERS)


@dataclass
class Net:
    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0
    #: Added to a logit, by language, so that the language's threshold is at THRESHOLD.
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    @classmethod
    def start(cls) -> Net:
        rng = np.random.default_rng(SEED)
        n = FILTERS * len(WIDTHS)
        return cls(
            rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
            rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32),
            np.zeros(n, np.float32),
            rng.normal(0, 0.3, n).astype(np.float32),
        )

    def answers(self, ids: np.ndarray) -> np.ndarray:
        """What each word adds to each filter."""
        return (self.table[ids >> 20] + self.table[ids & 0xFFFFF]) @ self.filters

    def convolve(self, answers: np.ndarray) -> np.ndarray:
        """Filter outputs at each word; beyond the end lies nothing."""
        n = len(answers)
        z = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for i, width in enumerate(WIDTHS):
            own = z[:, i * FILTERS : (i + 1) * FILTERS]
            own[:] = answers[:, columns(width, 0)]
            for k in range(1, min(width, n)):
                own[:-k] += answers[k:, columns(width, k)]
        return z

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.offset


def train(docs: list[np.ndarray], y: np.ndarray) -> Net:
    """Fit a net by stochastic gradient descent with step sizes by coordinate."""
    net, rng = Net.start(), np.random.default_rng(SEED)
    named = np.zeros(BUCKETS, np.int64)
    for ids in docs:
        named[np.unique(np.concatenate([ids >> 20, ids & 0xFFFFF]))] += 1
    rare = named < LEAST_DOCS
    net.table[rare] = 0
    squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("table", net.table), ("filters", net.filters), ("bias", net.bias), ("out", net.out))}
    offset_sq = 1e-3
    for epoch in range(min(max(EPOCHS[0], SHOWN // max(1, len(docs))), EPOCHS[1])):
        order = rng.permutation(len(docs))
        rate = RATE / (1 + 0.2 * epoch)
        for at in range(0, len(order), BATCH):
            batch = [k for k in order[at : at + BATCH] if len(docs[k])]
            if not batch:
                continue
            places, pooled = [], []
            for k in batch:
                z = net.convolve(net.answers(docs[k]))
                p = z.argmax(axis=0)
                places.append(p)
                pooled.append(z[p, np.arange(z.shape[1])])
            pooled = np.array(pooled)
            hidden = np.maximum(pooled + net.bias, 0)
            g = (1 / (1 + np.exp(-net.logit(pooled))) - y[batch]) / len(batch)
            g_hidden = np.outer(g, net.out) * (hidden > 0)
            steps = {"out": hidden.T @ g + 1e-4 * net.out, "bias": g_hidden.sum(axis=0), "filters": np.zeros_like(net.filters)}
            rows, grads = [], []
            for i, width in enumerate(WIDTHS):
                own = g_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(width):
                    cols = columns(width, k)
                    at_k = [p[i * FILTERS : (i + 1) * FILTERS] + k for p in places]
                    there = np.array([p < len(docs[d]) for d, p in zip(batch, at_k, strict=True)])
                    ids = np.array([docs[d][np.minimum(p, len(docs[d]) - 1)] for d, p in zip(batch, at_k, strict=True)])
                    e = (net.table[ids >> 20] + net.table[ids & 0xFFFFF]) * there[..., None]
                    steps["filters"][:, cols] += np.einsum("bf,bfd->df", own, e)
                    grad = (own[..., None] * net.filters[:, cols].T)[there]
                    rows += [ids[there] >> 20, ids[there] & 0xFFFFF]
                    grads += [grad, grad]
            for name, step in steps.items():
                squares[name] += step**2
                value = getattr(net, name)
                value -= rate * step / np.sqrt(squares[name])
            name, back = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(name), DIM), np.float32)
            np.add.at(total, back, np.concatenate(grads))
            total[rare[name]] = 0
            squares["table"][name] += total**2
            net.table[name] -= rate * total / np.sqrt(squares["table"][name])
            offset_sq += float(g.sum()) ** 2
            net.offset -= rate * float(g.sum()) / offset_sq**0.5
    return net


def threshold(at: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap around it, from counts of both classes at logits."""
    at, back = np.unique(at, return_inverse=True)
    toxic, other = (np.bincount(back, x, len(at))[::-1] for x in (toxic, other))
    at, hits = at[::-1], np.cumsum(toxic)
    f1 = 2 * hits / (hits + np.cumsum(other) + toxic.sum())
    k = int(f1.argmax())
    above = at[k]
    below = at[k + 1] if k + 1 < len(at) else above - 2
    return float(above + below) / 2


class Scorer:
    """Scores whole texts in one worker; a word's part in each filter is computed once."""

    def __init__(self, net: Net):
        self.net = net
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, net.filters.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > WORDS_KEPT:
            self.place.clear()
            self.known = self.known[:0]
            new = list(words)
        if new:
            self.place.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.known = np.concatenate([self.known, self.net.answers(np.array([word_ids(w) for w in new], np.int64))])

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text."""
        out, langs = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        cut = [WORD.findall((t or "").lower()) for t in texts]
        for k in range(0, len(cut), 256):
            self.learn(set().union(*cut[k : k + 256]))
            for i, words in enumerate(cut[k : k + 256], k):
                pooled = np.zeros(FILTERS * len(WIDTHS), np.float32) if not words else np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
                for at in range(0, len(words), STEP):  # a very long text goes in parts, which share two words
                    rows = np.fromiter(map(self.place.__getitem__, words[at : at + STEP + max(WIDTHS) - 1]), np.int64)
                    pooled = np.maximum(pooled, self.net.convolve(self.known[rows]).max(axis=0))
                out[i] = self.net.logit(pooled)
                langs[i] = language(words)
        return out, langs

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits, langs = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logits + self.net.shift[langs], -30, 30)))


def labelled(labels: DataFrame) -> DataFrame:
    """``label_id``, ``y``, a hash, and whether a label only sets thresholds, of all labels that may teach.

    A document that is labelled more than once is toxic if one of its labels says so.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("y")).where("y IS NOT NULL").where(~held_out("label_id", 4, 2))
    known = known.groupBy("label_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("label_id"))
    return known.withColumn("sets", F.pmod("h", F.lit(5)) == 0)


def sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> tuple[list[tuple[np.ndarray, int, int]], DataFrame]:
    """Word numbers, label and hash of at most FIT_ROWS documents of each class, and the table of their ids.

    Which documents are taken follows from a hash of their id: the first
    FIT_ROWS, as far as their texts have FIT_BYTES bytes together; a document
    with more than that alone is passed over.  Of rows that repeat an id one is
    taken.  A document's words come as its distinct word numbers and the place
    of each word's number among them.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = known.where(~F.col("sets")).join(texts.select("doc_id", F.octet_length("text").alias("n")), F.col("doc_id") == F.col("label_id"))
    sized = sized.groupBy("label_id", "h", "y").agg(F.max("n").alias("n")).where(F.col("n") <= FIT_BYTES)
    parts = [sized.where(F.col("y") == y).orderBy("h", "label_id").limit(FIT_ROWS) for y in (0, 1)]
    together = F.sum("n").over(W.partitionBy("y").orderBy("h", "label_id"))  # over the first FIT_ROWS only
    chosen = written(parts[0].unionByName(parts[1]).withColumn("together", together).where(F.col("together") <= FIT_BYTES), "chosen")
    rows = texts.join(F.broadcast(chosen.select("label_id", "h", "y")), F.col("doc_id") == F.col("label_id")).select("label_id", "h", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, places = [], []
            for x in b.column(3):
                name, place = np.unique(np.array([word_ids(w) for w in WORD.findall(x.as_py().lower())], np.int64), return_inverse=True)
                names.append(name)
                places.append(place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["label_id", "h", "y", "names", "places"])

    kind = known.schema["label_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"label_id {kind}, h long, y int, names array<long>, places array<int>")
    one = found.groupBy("label_id", "h", "y").agg(F.min(F.struct("names", "places")).alias("x")).select("h", "y", "x.names", "x.places").toArrow()
    out = [(n.values.to_numpy()[p.values.to_numpy()], y.as_py(), h.as_py()) for h, y, n, p in zip(*(one.column(c) for c in ("h", "y", "names", "places")), strict=True)]
    return sorted(out, key=lambda x: (x[2], len(x[0]))), chosen.select("label_id")


def fit(rows: list) -> tuple[Net, bool]:
    """A net from a sample, and whether it had both classes to learn from."""
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y)) < 2:
        net = Net.start()
        net.out[:] = 0
        net.offset = -4.0 if not len(y) or not y[0] else 4.0
        return net, False
    return train([r[0] for r in rows], y), True


def shifts(counts: np.ndarray) -> np.ndarray:
    """What to add to a logit, by language, from rows of language, bin, label, whether fitted on, and count.

    Fitted documents only say how frequent each class is: the others of a class
    stand for all of it.  A language with fewer than LANGUAGE_ROWS documents of
    a class among these has the threshold of all languages, as so few tell
    nothing; where even all languages have fewer toxic ones, fitted documents
    set the threshold as well.
    """
    lang, at, y, fitted, n = counts.T
    at = (at + 0.5) / BINS
    own = fitted == 0
    if n[own & (y == 1)].sum() < LANGUAGE_ROWS or not n[own & (y == 0)].sum():
        own[:] = True
    base = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def of(rows: np.ndarray) -> float:
        of_class = [rows & own & (y == c) for c in (1, 0)]
        weights = [n[rows & (y == c)].sum() / max(1, n[k].sum()) for c, k in zip((1, 0), of_class, strict=True)]
        used = rows & own
        return base - threshold(at[used], *((n * k * w)[used] for k, w in zip(of_class, weights, strict=True)))

    out = np.full(len(LANGUAGES), of(np.ones(len(n), bool)))
    for k in range(len(LANGUAGES)):
        if all(n[own & (lang == k) & (y == c)].sum() >= LANGUAGE_ROWS for c in (0, 1)):
            out[k] = of(lang == k)
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic``; null labels, and those of documents
    with crc32(doc_id) mod 4 = 2, teach nothing.  Of the others at most
    ``FIT_ROWS`` of each class, with at most ``FIT_BYTES`` of text together, are
    fitted on; all that aren't set the thresholds.  A document that is labelled
    twice is toxic if one of its labels says so.  A null text counts as empty,
    and a text without words gets what the net says of no words.  Repeated rows
    each give a row, and each counts for thresholds; without labels of both
    classes the net says nothing, and documents are clean.  Other columns are
    ignored; an empty table gives no rows.
    """
    known = labelled(labels)
    rows, fitted = sample(docs, known, id_col, text_col)
    net, learned = fit(rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                logits, langs = own.logits(b.column(1).slice(k, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 512), pa.array(logits), pa.array(langs.astype(np.int32))], ["doc_id", "logit", "lang"])

    scored = written(texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, logit double, lang int"), "logits")
    if learned:
        told = known.join(fitted.withColumn("fitted", F.lit(1)), "label_id", "left").join(scored, F.col("label_id") == F.col("doc_id"))
        at = F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("logit"))) * BINS).cast("int")
        counts = told.groupBy("lang", at.alias("at"), "y", F.coalesce("fitted", F.lit(0)).alias("fitted")).agg(F.count(F.lit(1)).alias("n")).collect()
        if counts:
            net.shift[:] = shifts(np.array([tuple(r) for r in counts], np.float64))
    shift = F.element_at(F.array(*(F.lit(float(x)) for x in net.shift)), F.col("lang") + 1)
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") + shift))
    scored = scored.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
