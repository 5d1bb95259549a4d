"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, every text scanned once where it lies.

Normalising maps bytes to bytes: A-Z to a-z, every other ASCII byte that is neither a letter nor a digit to a space, the rest
to itself. So a place in the normalised text is the same place in the original, and hits come back as spans of the original.

The symbols of the automaton are words: those of the benchmark have numbers, all others are 0, which no window holds. Patterns
are the windows of the items, so a match is one step a word, however many windows there are. Texts aren't shuffled.

The automaton is broadcast, so its size is counted first: at most ``PAIRS`` (window, item) pairs and ``PAIR_BYTES`` bytes of them.
A larger benchmark is dealt to several automata by a hash of the pair (so that a window in very many items is dealt, too); each
takes a scan of its own, and the hits of a document are put together by its row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, text_or_empty

#: Words of a window.
WINDOW = 10
#: Bytes of a text whose words are held at once.
PIECE = 1 << 22
#: (Window, item) pairs and their bytes in one automaton.
PAIRS, PAIR_BYTES = 1 << 18, 1 << 26

_SPACE, _KEPT = ord(" "), b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEPT else _SPACE for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Each run of ``size`` consecutive words; all of them as one, if they are fewer; none of none."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def window_pairs(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, item`` of every item, each pair once; a null id is the empty string."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(dict.fromkeys(windows(words_of(text), size)))
                for k in range(0, len(found), 4096):
                    part = found[k : k + 4096]
                    yield pa.RecordBatch.from_pydict({"window": pa.array(part, pa.binary()), "item": [item] * len(part)})

    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty("text").cast("binary").alias("text"))
    return items.mapInArrow(cut_up, "window binary, item string").distinct()


class Automaton:
    """Windows as sequences of word numbers; a match gives its last word, its length and its items."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.sizes: list[int] = []
        at: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for window, item in pairs:
            k = at.setdefault(bytes(window), len(at))
            if k == len(self.items):
                words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in bytes(window).split(b" "))
                self.machine.add_word(words, k)
                self.items.append([])
                self.sizes.append(len(words))
            self.items[k].append(item)
        self.longest = max(self.sizes, default=0)
        if at:
            self.machine.make_automaton()

    def matches(self, numbers: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """``(end, window)`` of every occurrence."""
        return self.machine.iter(numbers) if self.items else iter(())

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words of a normalised text, its maximal runs of words that are hit (first, last), in order, and the items of
        the windows that occur. Long texts are read a piece at a time, each with the last words of the one before."""
        n, found, spans = 0, set(), []
        last: tuple[int, ...] = ()
        for piece in pieces(text, PIECE):
            words = piece.split()
            numbers = (*last, *map(self.numbers.get, words, repeat(0)))
            before = len(last)
            for end, k in self.matches(numbers):
                if end >= before:
                    found.add(k)
                    spans.append((n + end - before - self.sizes[k] + 1, n + end - before))
            n += len(words)
            last = numbers[len(numbers) - self.longest + 1 :] if self.longest > 1 else ()
            if len(spans) > 1 << 16:
                spans = merged(spans)
        return n, merged(spans), {i for k in found for i in self.items[k]}


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A normalised text in pieces of about ``size`` bytes that don't cut words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end] if at or end < len(text) else text
        at = end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, last) that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words (of a normalised text: the original with each byte in its place) as places in the original: first code point, and
    the one behind the last."""
    if not spans:
        return []
    wanted = iter(x for span in spans for x in zip(span, (0, 1), strict=True))
    word, side = next(wanted)
    places, at, points = [], 0, 0
    a = np.frombuffer(text, np.uint8)
    for k, m in enumerate(re.finditer(rb"[^ ]+", text.translate(_NORMAL))):
        while k == word:
            upto = m.span()[side]
            points, at = points + int(np.count_nonzero((a[at:upto] & 0xC0) != 0x80)), upto
            places.append(points)
            word, side = next(wanted, (-1, 0))
        if word < 0:
            break
    return list(zip(places[::2], places[1::2], strict=True))


#: The automaton that this worker built last, by the name of its scan.
_BUILT: dict[str, Automaton] = {}


def _built(name: str, shared) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(shared.value)
    return _BUILT[name]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_HITS_DDL = "_row long, doc_id long, n_words long, hit array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def _scan(rows: DataFrame, pairs: list[tuple[bytes, str]], all_rows: bool) -> DataFrame:
    """Hits of one automaton: runs of words, spans of the original and items; of all rows, or of those with a hit."""
    shared, name = rows.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(name, shared)
        for batch in batches:
            out: list[dict] = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "doc_id", "text")), strict=True):
                n, runs, items = automaton.hits(text.translate(_NORMAL))
                if runs or all_rows:
                    pairs_of = lambda spans: [{"start": a, "end": b} for a, b in spans]
                    out.append({"_row": row, "doc_id": doc, "n_words": n, "hit": pairs_of(runs), "spans": pairs_of(original_spans(text, runs)), "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(out, _HITS)

    return rows.mapInArrow(scan, _HITS_DDL)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of several automata, put together; spans of the original likewise, where their runs of words touch."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            starts, ends = {}, {}
            for h, s in zip(r["hit"], r["spans"], strict=True):
                starts[h["start"]], ends[h["end"]] = s["start"], s["end"]
            runs = merged([(h["start"], h["end"]) for h in r["hit"]])
            r["hit"] = [{"start": a, "end": b} for a, b in runs]
            r["spans"] = [{"start": starts[a], "end": ends[b]} for a, b in runs]
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans``.

    A window is ``size`` consecutive words of an item, or all words of an item with fewer; a word of a document is hit inside any
    occurrence of a window. ``items`` are the ids (as strings, sorted) of the items with occurring windows, ``items_sha256`` the
    digest of them joined by commas; ``spans`` the maximal hit runs as code points of the original text, from ``start`` up to
    before ``end``. Null texts have no words; items without words have no windows; rows with one item id are one item, null ids
    are one item whose id is the empty string. An empty benchmark hits nothing, an empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = stored(window_pairs(benchmark, size), "windows")
    n, total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    shards = max(1, -(-n // PAIRS), -(-total // PAIR_BYTES))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    found = None
    for k in range(shards):
        own = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == k) if shards > 1 else pairs
        hits = _scan(rows, [tuple(r) for r in own.collect()], all_rows=k == 0)
        found = hits if found is None else found.unionByName(hits)
    if shards > 1:
        whole = F.flatten(F.collect_list("items"))
        found = found.groupBy("_row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(whole)).alias("items"))
        found = found.mapInArrow(_together, _HITS_DDL)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        "items",
        "spans",
    )
