"""Spelling variants: words that one edit turns into each other, by k-d trees over letter counts.

Words of one length are points, with one coordinate for each letter.  A replaced
letter takes one from a coordinate and adds one to another; an inserted one only
adds.  So what a word may be near lies within a distance (L1) of two in its own
length and of one in the next, and a box that is further away is left out.  For
each length a k-d tree has two storeys: the upper one cuts space into cells, and
words go to the cells within reach; the lower one, over the words of a cell, is
searched in the task that has them.  Order of letters is checked last.

A task gives one row for each word that has near words in a cell, never pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_enough, table, texts_of, written

#: Code points of at least so many, and so many occurrences, make a word; a form
#: is so many times as frequent as its variant.
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many runs loses a character.
DAMAGE = 199
#: Words in a cell, and in a leaf of its tree; words of a length whose cells are
#: cut by a sample, which decides how even cells are and nothing else.
CELL_WORDS, LEAF_WORDS, SAMPLE_WORDS = 16_000, 32, 20_000
#: Words that a task counts before it hands the counts on, and queries that meet a tree at once.
TASK_WORDS, QUERIES = 200_000, 4096

# Letters are those of Latin-1 here, each one byte: A-Z in lower case, others as they are.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, as Latin-1, with A-Z in lower case."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(word: bytes, prefix: int) -> bytes:
    """The word, or the word without one character if the check sum of ``<doc_id>:<word>`` says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all words of ``docs``; tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                prefix, here = zlib.crc32(f"{'' if i is None else i}:".encode()), {}
                for w in runs(x.as_py()):
                    if len(w) >= least_chars:
                        here[w] = here.get(w, 0) + 1
                for w, n in here.items():
                    w = damaged(w, prefix)
                    if len(w) >= least_chars:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) >= TASK_WORDS:
                    yield handed()
        yield handed()

    found = texts_of(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length, one row each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(m: np.ndarray) -> np.ndarray:
    """How often each of 256 letters stands in each row."""
    out = np.zeros((len(m), 256), np.int32)
    rows = np.arange(len(m))
    for k in range(m.shape[1]):
        out[rows, m[:, k]] += 1  # a row once for each column, so nothing is lost
    return out


@dataclass
class Cells:
    """The upper storey for one length: cuts by the count of one letter, cells at the ends."""

    letter: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)  # on the lower side the letter stands so often at most
    below: list[int] = field(default_factory=list)  # node on either side, or -1 - cell
    above: list[int] = field(default_factory=list)
    cells: int = 1

    @staticmethod
    def cut(sample: np.ndarray, wanted: int) -> Cells:
        """As many cells as wanted, as even for a sample of letter counts as its values allow."""
        out = Cells(cells=0)

        def grow(rows: np.ndarray, wanted: int) -> int:
            at = best_cut(rows) if wanted > 1 and len(rows) > 1 else None
            if at is None:
                out.cells += 1
                return -out.cells
            letter, most = at
            low = rows[:, letter] <= most
            k = len(out.letter)
            for x, v in ((out.letter, letter), (out.most, most), (out.below, 0), (out.above, 0)):
                x.append(v)
            share = min(wanted - 1, max(1, round(wanted * low.mean())))
            out.below[k] = grow(rows[low], share)
            out.above[k] = grow(rows[~low], wanted - share)
            return k

        grow(sample, wanted)
        return out

    def reached(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Cells, with the rows whose reach they lie in: so many letters more than the row has, and so many less."""
        # nodes with rows, letters gained and lost so far, by letter, on the way to a side that the row isn't on
        stack = [(0 if self.letter else -1, np.arange(len(counts)), {})]
        while stack:
            k, rows, needs = stack.pop()
            if k < 0:
                yield -1 - k, rows
                continue
            own = counts[rows, self.letter[k]]
            for to, need in ((self.below[k], np.minimum(0, self.most[k] - own)), (self.above[k], np.maximum(0, self.most[k] + 1 - own))):
                # for one letter the cuts that ask most on either side count once
                lost, gained = needs.get(self.letter[k], (np.zeros(len(rows), int), np.zeros(len(rows), int)))
                all_needs = needs | {self.letter[k]: (np.minimum(lost, need), np.maximum(gained, need))}
                ok = (sum(g for _, g in all_needs.values()) <= more) & (sum(-x for x, _ in all_needs.values()) <= less)
                if ok.any():
                    stack.append((to, rows[ok], {c: (x[ok], g[ok]) for c, (x, g) in all_needs.items()}))


def best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter whose count varies most, and the value nearest to its middle; none if all rows are alike."""
    spread = counts.var(axis=0)
    if not len(counts) or not spread.max():
        return None
    letter = int(spread.argmax())
    values = np.sort(counts[:, letter])
    middle = values[len(values) // 2]
    # all up to the middle, or all below it: whichever is more even
    options = [v for v in (middle - 1, middle) if values[0] <= v < values[-1]]
    return letter, int(min(options, key=lambda v: abs(2 * np.searchsorted(values, v, side="right") - len(values))))


class Codes:
    """Letter counts as bits, one for each letter and how often it stands: distances are counts of differing bits."""

    def __init__(self, points: np.ndarray):
        most = letter_counts(points).max(axis=0)
        start = np.r_[0, np.cumsum(most)]
        self.start, self.most, self.words = start[:-1], most, max(1, -(-int(start[-1]) // 64))

    def of(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, and how many of their letters no point has."""
        s, rows = np.sort(m, axis=1), np.arange(len(m))
        code, beyond, rank = np.zeros((len(m), self.words), np.uint64), np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
        for k in range(m.shape[1]):
            if k:
                rank = np.where(s[:, k] == s[:, k - 1], rank + 1, 0)
            known = rank < self.most[s[:, k]]
            bit = self.start[s[:, k]] + rank
            r, b = rows[known], bit[known]
            code[r, b >> 6] |= np.uint64(1) << (b & 63).astype(np.uint64)
            beyond += ~known
        return code, beyond


class Tree:
    """The lower storey: a k-d tree over the words of a cell, all of one length."""

    def __init__(self, words: list[bytes], n: np.ndarray, leaf: int = LEAF_WORDS):
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        self.words, self.n = [words[k] for k in order], np.asarray(n)[order]
        self.points = matrix(self.words)
        self.codes = Codes(self.points)
        self.code, _ = self.codes.of(self.points)
        counts = letter_counts(self.points)[:, np.unique(self.points)].astype(np.int16)
        #: Of each node the bits that all its points have, those that any has, and its children or its points.
        self.low, self.high, self.kids, self.own = [], [], [], []
        stack = [(np.arange(len(words)), None)]
        while stack:
            rows, parent = stack.pop()
            k = len(self.low)
            if parent is not None:
                self.kids[parent].append(k)
            self.low.append(np.bitwise_and.reduce(self.code[rows], axis=0))
            self.high.append(np.bitwise_or.reduce(self.code[rows], axis=0))
            self.kids.append([])
            at = best_cut(counts[rows]) if len(rows) > leaf else None
            self.own.append(rows if at is None else None)
            if at is not None:
                side = counts[rows, at[0]] <= at[1]
                stack += [(rows[side], k), (rows[~side], k)]

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs, of ``words`` and of points, that one edit turns into each other.

        ``words`` are of the points' length, where a letter is replaced, or one
        shorter, where one is inserted.
        """
        m = matrix(words)
        shorter = m.shape[1] < self.points.shape[1]
        code, beyond = self.codes.of(m)
        less, reach = (0, 1) if shorter else (1, 2)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(0, np.flatnonzero(beyond <= less))]
        while stack:
            k, rows = stack.pop()
            mine = code[rows]
            gained = np.bitwise_count(self.low[k] & ~mine).sum(axis=1, dtype=np.int64)
            lost = np.bitwise_count(mine & ~self.high[k]).sum(axis=1, dtype=np.int64) + beyond[rows]
            rows = rows[(gained <= 1) & (lost <= less)]
            if not len(rows):
                continue
            if self.own[k] is None:
                stack += [(c, rows) for c in self.kids[k]]
                continue
            own = self.own[k]
            for s in range(0, len(own), LEAF_WORDS):  # words of the same letters all stand in one leaf
                part = own[s : s + LEAF_WORDS]
                apart = np.bitwise_count(code[rows][:, None, :] ^ self.code[part][None, :, :]).sum(axis=2, dtype=np.int64) + beyond[rows][:, None]
                a, b = np.nonzero(apart == reach)
                if len(a):
                    a, b = rows[a], part[b]
                    ok = inserted(m[a], self.points[b]) if shorter else (m[a] != self.points[b]).sum(axis=1) == 1
                    found.append((a[ok], b[ok]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether one letter put into the row of ``short`` gives the row of ``long``."""
    n = short.shape[1]
    ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def best_of(words: list[bytes], n: np.ndarray, of: np.ndarray, other: np.ndarray, names: list[bytes], counts: np.ndarray) -> tuple[list, list, list, list, list]:
    """For every place in ``of`` the word there, its number, how many near words it has, and the most frequent of these."""
    order = np.argsort(of, kind="stable")
    of, other = of[order], other[order]
    at, start, size = np.unique(of, return_index=True, return_counts=True)
    best = [min(other[s : s + k], key=lambda x: (-counts[x], names[x])) for s, k in zip(start, size, strict=True)]
    return [words[k] for k in at], [int(n[k]) for k in at], size.tolist(), [names[x] for x in best], [int(counts[x]) for x in best]


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``best`` and ``best_n``: how many words are near a word, and the most frequent of these.

    ``words`` has ``word``, letters of Latin-1 in lower case, once, and ``n``.
    Of equally frequent words the first in code-point order is the best.
    """
    lengths = {r.chars: r.words for r in words.groupBy(F.length("word").alias("chars")).agg(F.count(F.lit(1)).alias("words")).collect()}
    cuts: dict[int, Cells] = {}
    for chars, total in lengths.items():
        wanted = -(-total // cell_words)
        if wanted == 1:
            cuts[chars] = Cells()
            continue
        drawn = words.where(F.length("word") == chars).orderBy(F.xxhash64("word")).limit(SAMPLE_WORDS).select("word").collect()
        cuts[chars] = Cells.cut(letter_counts(matrix([r.word.encode("latin-1") for r in drawn])), wanted)
    first = dict(zip(sorted(cuts), np.cumsum([0, *(cuts[k].cells for k in sorted(cuts))]).tolist(), strict=False))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            by_length: dict[int, list[tuple[bytes, int]]] = {}
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_length.setdefault(len(w), []).append((w.encode("latin-1"), n))
            for chars, rows in by_length.items():
                counts = letter_counts(matrix([w for w, _ in rows]))
                names = np.array([w.decode("latin-1") for w, _ in rows], object)
                n = np.array([n for _, n in rows], np.int64)
                # as a point (0), as a query among words of its own length (1), and of the next (2)
                for role, to, more, less in ((0, chars, 0, 0), (1, chars, 1, 1), (2, chars + 1, 1, 0)):
                    for cell, at in cuts[to].reached(counts, more, less) if to in cuts else ():
                        out.append((np.full(len(at), first[to] + cell, np.int32), np.full(len(at), role, np.int32), names[at], n[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["cell", "role", "word", "n"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, points, tree = None, [], None
        waiting: dict[int, list[tuple[bytes, int]]] = {1: [], 2: []}

        def rows(columns: tuple[list, ...]) -> pa.RecordBatch:
            words, _, near, best, best_n = columns
            text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
            return pa.RecordBatch.from_arrays([text(words), pa.array(near, pa.int64()), text(best), pa.array(best_n, pa.int64())], ["word", "n_near", "best", "best_n"])

        def settle(role: int) -> Iterator[pa.RecordBatch]:
            asked, waiting[role] = waiting[role], []
            if not asked or tree is None:
                return
            words, n = [w for w, _ in asked], np.array([n for _, n in asked], np.int64)
            a, b = tree.near(words)
            if len(a):
                yield rows(best_of(words, n, a, b, tree.words, tree.n))
                if role == 2:  # words of its own length ask for themselves; longer ones are asked here
                    yield rows(best_of(tree.words, tree.n, b, a, words, n))

        for batch in batches:
            for c, role, word, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if c != cell:
                    for r in (1, 2):
                        yield from settle(r)
                    cell, points, tree = c, [], None
                if role == 0:
                    points.append((word.encode("latin-1"), n))
                    continue
                if tree is None and points:
                    tree, points = Tree([w for w, _ in points], np.array([n for _, n in points], np.int64)), []
                waiting[role].append((word.encode("latin-1"), n))
                if len(waiting[role]) >= QUERIES:
                    yield from settle(role)
        for r in (1, 2):
            yield from settle(r)

    rows = words.select("word", "n").mapInArrow(dealt, "cell int, role int, word string, n long")
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, sum(c.cells for c in cuts.values())))
    found = rows.repartition(parts, "cell").sortWithinPartitions("cell", "role").mapInArrow(searched, "word string, n_near long, best string, best_n long")
    order = F.struct((-F.col("best_n")).alias("less"), F.col("best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("top")).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of the forms that lead on from it; ``forms`` has ``word`` and ``form``.

    A form is several times as frequent as the word, so chains are short and
    have an end; each round doubles how far a word looks.
    """
    far = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = far.join(small_enough(on), "root", "left")
        if ahead.where("next IS NOT NULL").isEmpty():
            return far
        far = written(ahead.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, cell_words: int = CELL_WORDS) -> DataFrame:
    """One row for each word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    Words are runs of letters of Latin-1 with A-Z in lower case, of at least six
    code points and five occurrences.  A word's form is its most frequent near
    word (the first in code-point order, of equals) if that is at least five
    times as frequent, else null; its root is what forms lead to, or itself.

    Null and empty texts have no words.  A null id counts as an empty one for
    the check sum that damages runs; rows that repeat an id and a text count
    once each.  Texts are read whole and runs may be of any length.  Other
    columns are ignored; an empty table gives no rows.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, cell_words)
    path = scratch_path(docs.sparkSession, "near-words")
    is_form = F.col("best_n") >= F.lit(times) * F.col("n")
    all_words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    all_words.write.parquet(path)
    found = docs.sparkSession.read.schema(all_words.schema).parquet(path)
    last = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")
