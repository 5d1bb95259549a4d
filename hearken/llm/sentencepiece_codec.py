"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Text is cut into marked words (white space marks and what follows). The distinct words of a batch are sorted, so that
they stand in the depth-first order of their trie; walking it, the forward scores of a common prefix are computed
once and reused. An edge of the lattice is a piece that ends at a prefix.

* Unigram models: the classic Viterbi recursion, best sum of log probabilities.
* BPE models (scores are merge ranks, not probabilities): the state of a prefix is the last piece of its encoding.
  A piece may follow the last piece of the shorter prefix exactly if merging the two together leaves them apart, and
  one admissible path survives for each prefix. So the result is that of the merges, still left to right.

Tasks work on Arrow batches next to the data; nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Encoded words that a worker remembers.
REMEMBERED = 1 << 17
#: Words longer than this are not remembered.
SHORT = 64
#: Bytes of text that are cut into words at once; a longer text is alone.
AT_ONCE = 1 << 20
#: Columns of the result.
MADE = ("ids", "n_ids", "decoded")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        x |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return x, i


def _message(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, int, bytes or float)."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif tag & 7 == 5:
            v, i = float(np.frombuffer(b, "<f4", 1, i)[0]), i + 4
        else:
            v, i = float(np.frombuffer(b, "<f8", 1, i)[0]), i + 8
        yield tag >> 3, v


class Model:
    """Pieces, scores and the settings of a model file that matter here."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        self.pieces, self.kinds, scores = [], [], []
        self.bpe, self.dummy_prefix, self.squeeze, self.charsmap = False, True, True, b""
        for k, v in _message(data):
            if k == 1:
                f = dict(_message(v))
                self.pieces.append(f[1].decode())
                scores.append(f.get(2, 0.0))
                self.kinds.append(f.get(3, 1))
            elif k == 2:
                self.bpe = dict(_message(v)).get(3, 1) == 2
            elif k == 3:
                f = dict(_message(v))
                self.charsmap, self.dummy_prefix, self.squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if self.charsmap or self.has_user_pieces():
            raise ValueError("models with a normalization table or user-defined pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == self.NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == self.BYTE}
        # a mark inside a piece, after another character, would join words
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span words are not supported")
        self.pairs: dict[tuple[str, str], bool] = {}
        # pieces that merging their own characters gives; others never come up
        self.whole = {p: p for p in self.ids if not self.bpe or len(p) == 1 or self.merges([*p]) == [p]}
        self.words = self._word_pattern()
        self.id_bytes = {p: array("i", [i]).tobytes() for p, i in self.ids.items()}
        # by their last two characters, the length of the longest of them
        self.reach: dict[str, int] = {}
        for p in self.whole:
            self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))
        self.bytes_of = [self._piece_bytes(i) for i in range(len(self.pieces))]

    def has_user_pieces(self) -> bool:
        return self.USER in self.kinds

    def piece_ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode()]
        return [self.unknown]

    def merges(self, symbols: list[str]) -> list[str]:
        """The plain merging of a few characters: best score first, the leftmost of equals."""
        while len(symbols) > 1:
            at = [(-s, i) for i in range(len(symbols) - 1) if (s := self.score.get(symbols[i] + symbols[i + 1])) is not None]
            if not at:
                break
            i = min(at)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _word_pattern(self) -> re.Pattern[str]:
        """Where texts may be cut, by the vocabulary: before marks; and between letters, digits and others if no piece has
        a character of one next to one of another."""
        kinds = [(re.compile(r"[^\W\d_]"), "l"), (re.compile(r"\d"), "d")]
        kind = lambda c: "m" if c == MARK else next((k for r, k in kinds if r.match(c)), "o")
        self.glue = {c for p in self.ids for x, y in zip(p, p[1:], strict=False) if x != MARK and kind(x) != kind(y) for c in (x, y)}
        return re.compile(rf"{MARK}*(?:[^\W\d_]+|\d+|(?:[^\w{MARK}]|_)+)|{MARK}+")

    def _piece_bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == self.BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == self.UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == self.CONTROL else self.pieces[i].replace(MARK, " ").encode()

    def apart(self, key: tuple[str, str]) -> bool:
        """BPE: whether two pieces next to each other stay two."""
        if len(self.pairs) > 1 << 19:
            self.pairs.clear()
        found = self.pairs[key] = self.merges([*key[0], *key[1]]) == [*key]
        return found

    def best_piece(self, word: str, score: array, k: int) -> tuple[int, float]:
        """Unigram: where the last piece of the best split of ``word[:k]`` starts, and that split's score."""
        at, best = k - 1, score[k - 1] + self.score.get(word[k - 1], self.unknown_score)
        for i in range(max(0, k - self.longest), k - 1):
            piece = word[i:k]
            if piece in self.ids and (s := score[i] + self.score[piece]) > best:
                at, best = i, s
        return at, best

    def unknown_bytes(self, piece: str) -> bytes:
        return array("i", self.piece_ids(piece)).tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (as bytes of 32-bit integers) of distinct words. Sorted, they stand in the depth-first order of their trie:
        the forward states of the prefix that a word shares with the one before it are kept. A state is where the prefix's
        last piece begins, so memory is linear in the longest word; ids are read off once, from the end of a word."""
        out, before = {}, ""
        # by length of prefix: its last piece, where that begins and, for unigram models, the score of the best split
        last, back, score = [""], array("q", [0]), array("d", [0.0])
        bpe, whole, pairs, reach, ids_of = self.bpe, self.whole, self.pairs, self.reach, self.id_bytes
        for w in sorted(words):
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del last[same + 1 :], back[same + 1 :]
            if not bpe:
                del score[same + 1 :]
            for k in range(same + 1, len(w) + 1):
                at = k - 1  # one character, known or not, unless another piece fits
                piece = w[at]
                if bpe:
                    for i in range(max(0, k - reach.get(w[k - 2 : k], 1)), k - 1):
                        longer = whole.get(w[i:k])
                        if longer is not None:
                            key = (last[i], longer)
                            if i == 0 or (pairs[key] if key in pairs else self.apart(key)):
                                at, piece = i, longer
                                break
                else:
                    at, best = self.best_piece(w, score, k)
                    piece = w[at:k]
                    piece = whole.get(piece, piece)
                    score.append(best)
                last.append(piece)
                back.append(at)
            parts, k = [], len(w)
            while k:
                piece = last[k]
                parts.append(ids_of.get(piece) or self.unknown_bytes(piece))
                k = back[k]
            ids = b"".join(reversed(parts))
            if not bpe and not self.byte_ids:  # runs of unknown characters are one unknown
                x = np.frombuffer(ids, np.int32)
                ids = x[np.append(True, (x[1:] != x[:-1]) | (x[1:] != self.unknown))].tobytes()
            out[w] = ids
            before = w
        return out

    def cut(self, text: str) -> list[str]:
        """A text's marked words."""
        m = self.marked(text)
        if self.glue and not self.glue.isdisjoint(m):
            return WORDS.findall(m)
        return self.words.findall(m)

    def marked(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``; runs of byte pieces are UTF-8, invalid bytes become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


#: Runs of marks stand before the word that follows.
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """A model with the words that this worker has met."""

    def __init__(self, data: bytes):
        self.model, self.known = Model(data), {}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.model.cut(t) for t in texts]
        wanted = set().union(*cut)
        fresh = self.model.encode_words([w for w in wanted if w not in self.known])
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {w: self.known[w] for w in wanted if w in self.known}
        self.known.update(fresh)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut]
        for w in fresh:
            if len(w) > SHORT:
                del self.known[w]
        return out


def in_slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``b`` in order, in slices of at most ``AT_ONCE`` bytes of the texts in ``column``, or one longer text."""
    ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        upto = int(np.searchsorted(ends, AT_ONCE + (ends[at - 1] if at else 0), side="right"))
        upto = max(upto, at + 1)
        yield b.slice(at, upto - at)
        at = upto


def encode_rows(c: Codec, b: pa.RecordBatch, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``carried`` of ``b`` with what :func:`encode` adds; the texts follow them. A word is an object in a worker, a dozen
    times as large as in the text, and workers keep what they have once taken: so a batch is handled in slices."""
    for part in in_slices(b, len(carried)):
        ids = c.encode_batch(part.column(len(carried)).to_pylist())
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        cols = [*part.columns[: len(carried)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        cols += [pa.array(np.diff(offsets)), pa.array([c.model.decode(x.tolist()) for x in ids], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [*carried, *MADE])


@cache
def codec(name: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read())


def _model_name(spark, model_path: str) -> str:
    spark.sparkContext.addFile(model_path)  # executors fetch it; the path need not exist there
    return model_path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_ids`` and ``decoded`` (the text that the ids give back).

    Null text counts as empty; an empty text has no ids. Texts and words may be of any length: memory is linear in the
    longest word. Columns of ``docs`` named ``ids``, ``n_ids`` or ``decoded``
    are replaced. Rows are handled one by one, so repeated rows give equal ids and an empty table gives no rows.
    ``columns`` names the columns of ``docs`` to carry (default all).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    name = _model_name(spark, model_path)
    carried = [c for c in (columns or docs.columns) if c not in MADE]
    rows = docs.select(*carried, text_or_empty("text").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from encode_rows(codec(name), b, carried)

    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name != "ids"])
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", T.IntegerType()).add("decoded", T.StringType())
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids give an empty text."""
    name = _model_name(encoded.sparkSession, model_path)

    @F.pandas_udf("string")
    def text_of(ids):
        m = codec(name).model
        return ids.map(lambda x: "" if x is None else m.decode(x.tolist()))

    return encoded.withColumn("decoded", text_of("ids"))
