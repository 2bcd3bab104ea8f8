"""Encoding and decoding with a merge-type subword model by a prefix table.

For merges ranked by the piece they make, a sequence of pieces is the encoding
of its text exactly if each piece encodes to itself and each two neighbours
encode to themselves as a pair: the first merge across a border would show in
the pair as well.  So every prefix of a text has one encoding, the encoding of a
shorter prefix plus one last piece.  ``PieceModel.encode`` goes once over the
text; at each place an automaton names the pieces that end there, and the one
that is compatible with the last piece before it goes into the table.  The ids
are then read backwards.  Characters outside the vocabulary stand alone and
become bytes.

No piece holds a space mark after another character, so no merge crosses from a
word to the next blank; words are encoded once and kept in a worker's cache
until it runs another helper.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table, texts_of

MARK = "▁"
#: Words of a worker's newer cache (the older one has as many; about 250 bytes each),
#: the longest word it keeps, and pairs of pieces likewise (about 80 bytes each).
CACHE_SIZE, CACHE_CHARS = 150_000, 64
PAIRS_SIZE = 400_000


class PieceModel:
    """Vocabulary, automaton and pair test of one model file."""

    def __init__(self, path: str, pairs: int | None = None):
        import ahocorasick
        import sentencepiece

        self.size = pairs or PAIRS_SIZE
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.piece = {i: model.id_to_piece(i) for i in range(size) if i not in special and not model.is_byte(i)}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece of this model reaches across a blank")
        self.raw = {i: p.replace(MARK, " ").encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.raw |= {i: b"" for i in special if model.is_control(i)} | {model.unk_id(): " ⁇ ".encode()}
        #: Two characters side by side in some piece; between any others no merge happens.
        self.inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self._merge(list(p)) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def _merge(self, symbols: list[str]) -> list[str]:
        """The model's merges on a short list of symbols: best score first, then leftmost."""
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, side by side, are their own encoding; remembered by both ids."""
        if len(self.pairs) >= self.size:
            self.older, self.pairs = self.pairs, {}
        both = left << 32 | right
        known = self.older.get(both)
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = a[-1] + b[0] not in self.inner or self._merge(list(a + b)) == [a, b]
        self.pairs[both] = known
        return known

    def last_pieces(self, text: str) -> list[int | None]:
        """For each prefix of ``text`` the last piece of its encoding; none for an unknown character.

        The automaton names the pieces that end at a place from the longest on.
        """
        last: list[int | None] = [None] * len(text)
        known, compatible = self.pairs.get, self.compatible
        for end, (piece, length) in self.automaton.iter(text):
            if last[end] is None:
                start = end - length
                if start < 0 or (left := last[start]) is None:  # after an unknown character nothing merges
                    last[end] = piece
                elif (fits := known(left << 32 | piece)) or fits is None and compatible(left, piece):
                    last[end] = piece
        return last

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose blanks are marks already."""
        last, out, at = self.last_pieces(text), [], len(text)
        while at:
            i = last[at - 1]
            if i is None:
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(text[at].encode()))
            else:
                at -= len(self.piece[i])
                out.append(i)
        return out[::-1]

    def encode_text(self, text: str) -> list[int]:
        return self.encode(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids; one leading blank, which encoding adds, goes again.

        Bytes that aren't UTF-8 become U+FFFD one by one.
        """
        first = next((i for i in ids if self.raw[i]), -1)
        return self.finish(b"".join([self.raw[i] for i in ids]), self.piece.get(first, "").startswith(MARK))

    @staticmethod
    def finish(raw: bytes, marked: bool) -> str:
        raw = raw[1:] if marked else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="surrogateescape").translate({c: 0xFFFD for c in range(0xDC80, 0xDD00)})


WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TAIL = re.compile(r"(.*\w)([^\w▁]+)", re.DOTALL)


class Codec:
    """Encodes and decodes whole texts in one worker, word by word through its cache.

    The cache has a word's ids, joined by commas, and the bytes they decode to.
    When it is full it becomes the older one, from which words that come again
    are taken over, so that frequent words stay.
    """

    def __init__(self, path: str, words: int | None = None, pairs: int | None = None):
        self.model, self.size = PieceModel(path, pairs), words or CACHE_SIZE
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def word(self, word: str) -> tuple[str, bytes]:
        if found := self.older.get(word):
            return self.keep(word, found)
        m = TAIL.fullmatch(word)
        if m and m[1][-1] + m[2][0] not in self.model.inner:  # the marks after a word are apart from it
            (a, x), (b, y) = (self.cache.get(w) or self.word(w) for w in m.groups())
            return f"{a},{b}", x + y
        ids = self.model.encode(word)
        found = ",".join(map(str, ids)), b"".join([self.model.raw[i] for i in ids])
        return self.keep(word, found) if len(word) <= CACHE_CHARS else found

    def keep(self, word: str, found: tuple[str, bytes]) -> tuple[str, bytes]:
        if len(self.cache) >= self.size:
            self.older, self.cache = self.cache, {}
        self.cache[word] = found
        return found

    def run(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        cache, word = self.cache, self.word
        found = [cache.get(x) or word(x) for x in WORDS.findall(MARK + text.replace(" ", MARK))]
        ids = ",".join([w[0] for w in found])
        return ids.count(",") + 1, ids, self.model.finish(b"".join([w[1] for w in found]), True)


def codec(path: str, words: int | None = None, pairs: int | None = None) -> Codec:
    return kept(("codec", path, words, pairs), lambda: Codec(path, words, pairs))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, words: int | None = None, pairs: int | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the text that the ids decode to, for each row of ``docs``.

    ``path`` is a model file that every worker can open.  A null or empty text
    has no ids and decodes to an empty text.  With ``digests`` the columns are
    ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and
    ``decoded_sha256`` instead, so that no long column leaves the worker.
    ``words`` and ``pairs`` bound a worker's caches where memory is short; they
    decide speed only.
    Repeated rows each give a row; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, words, pairs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            found = (own.run(x.as_py() or "") for x in b.column(1))
            if digests:
                cols = list(zip(*((n, sha(ids), sha(text)) for n, ids, text in found), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                cols = list(zip(*(([int(i) for i in ids.split(",")] if ids else [], text) for _, ids, text in found), strict=True)) or [[], []]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.string())], ["doc_id", "ids", "decoded"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {out}")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` for a table of id lists; a null list gives an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
