"""Runs of windows that share a minimiser, packed and sent to buckets; the helpers of both substring deduplications.

A window's minimiser is the first of the short grams inside it, in an order of hashes in which grams that are frequent
in the whole table come last. Equal windows have equal minimisers and meet in one bucket; consecutive windows mostly
share theirs and travel as one string. Frequent grams are found by Misra-Gries counters over all texts. Where a passage
of many documents meets each one's own words, the windows then go by the own words, not all to the passage's bucket.

Tasks drop repeats of a string within their batch, and repeats of strings with a frequent minimiser within the task: only
its first owner is sent on, the others are settled at once. So what a third of all documents share arrives at its bucket
about once a task, not once a document.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, n_tasks, text_or_empty

BASE = 0x9E3779B97F4A7C15
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Documents without an id sort last.
NO_ID = np.iinfo(np.int64).max
MB = 1 << 20
#: Bytes of text a task handles at once, and bytes of packed strings a bucket should get.
BATCH_BYTES, BUCKET_BYTES = 3 << 20, 6 << 20
#: Bytes of packed strings that a task gets at most on average; it handles one bucket after another.
TASK_BYTES = 256 << 20
#: Bytes of a bucket's text that are held in memory; more is on disk.
SHARD_BYTES = 48 << 20
BLOCK = 1 << 19
#: Bytes of the grams of byte strings.
GRAM = 12
#: A gram is frequent with more than 1/HEAVY of all places, and at least so many. A task counts with so many counters and
#: keeps back what is under half of 1/HEAVY of its own places, so fewer than 4 * HEAVY grams are named frequent, whatever
#: the table.
HEAVY, LEAST_PLACES, COUNTERS = 1 << 13, 1024, 1 << 15
#: Strings with a frequent minimiser that a task remembers; further ones are sent once a batch.
REMEMBERED = 1 << 16
TOP = np.uint64(1 << 63)


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)  # modulo 2**64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hash of any slice of a byte array in constant time; equal slices have equal hashes."""

    def __init__(self, a: np.ndarray):
        n = len(a)
        size = (n >> 20) + 1 << 20
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[:n], out=self.sum[1:])
        self.back = _powers(pow(BASE, -1, 1 << 64), size)  # the base is odd

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sum[end] - self.sum[start]) * self.back[start])


K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_at(a: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as one number."""
    n = max(len(a) - 7, 0)
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = (n - k + 7) // 8
        out[k::8] = a[k : k + 8 * m].view(np.uint64)
    return out


def gram_hashes(a: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all slices of 12 bytes, a block at a time; ``words``: what :func:`words_at` gave, if at hand."""
    n = max(len(a) - GRAM + 1, 0)
    out = np.empty(n, np.uint64)
    for k in range(0, n, BLOCK):
        w = words_at(a[k : k + BLOCK + GRAM - 1]) if words is None else words[k : k + BLOCK + 4]
        out[k : k + BLOCK] = mixed(w[:-4] * K1 + w[4:] * K2)
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def shuffled(a: np.ndarray) -> bytes:
    """Bytes of an integer array by significance, which compress better."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""


def unshuffled(b: bytes, kind) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(k, -1).T.copy().view(kind).ravel() if b else np.zeros(0, kind)


def pack(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, strings: list[bytes], gone: np.ndarray) -> bytes:
    """Strings with their owners and places, and rows of ``gone`` (doc, tag, start, end) that are settled."""
    size = np.array([len(s) for s in strings], np.int32)
    parts = [shuffled(doc), shuffled(tag), shuffled(at), shuffled(size), b"".join(strings), shuffled(gone.ravel())]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, np.int64, 6)) + 48
    part = [raw[a:b] for a, b in zip(np.append(48, ends), ends, strict=False)]
    size = unshuffled(part[3], np.int32)
    return unshuffled(part[0], np.int64), unshuffled(part[1], np.int64), unshuffled(part[2], np.int64), size, part[4], unshuffled(part[5], np.int64).reshape(-1, 4)


def id_facts(docs: DataFrame) -> tuple[bool, int | None]:
    """Whether an id (or its lack) is on several rows, and the ``gap`` for :func:`doc_key`: where rows without an id stand beside the
    largest long, the largest id that no row has."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("d")).count()
    most, without, largest = ids.agg(F.max("count"), F.max(F.col("d").isNull()), F.max("d")).first()
    gap = None
    if without and largest == NO_ID:
        have = ids.select("d").filter("d is not null")
        gap = have.filter(F.col("d") > np.iinfo(np.int64).min).select((F.col("d") - 1).alias("d")).join(have, "d", "left_anti").agg(F.max("d")).first()[0]
    return (most or 0) > 1, gap


def doc_key(repeated: bool, gap: int | None = None) -> dict[str, Column]:
    """``doc`` and ``tag`` stand for a row in both scans. ``doc`` has the order of the ids, none after all others: it is the id, but that those beyond
    the ``gap`` move down by one, so that the largest long is free. The tag, a hash of the text, tells rows apart that share an id;
    it is zero where no id repeats."""
    d = F.col("doc_id").cast("long")
    return {
        "doc": F.coalesce(d if gap is None else F.when(d > gap, d - 1).otherwise(d), F.lit(int(NO_ID))),
        "tag": F.xxhash64("text") if repeated else F.lit(0).cast("long"),
    }


def demoted(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes of grams, changed so that those of ``frequent`` (sorted) come after all others."""
    out = h >> np.uint64(1)
    if len(frequent):
        flags = np.zeros(1 << 20, bool)
        flags[frequent >> np.uint64(44)] = True
        at = np.flatnonzero(flags[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(frequent, h[at]), len(frequent) - 1)
        out[at[frequent[k] == h[at]]] |= TOP
    return out


class Counters:
    """Misra-Gries: counts of hashes, each too low by at most ``seen / most``."""

    def __init__(self, most: int):
        self.most, self.seen = most, 0
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.seen += len(h)
        key, n = np.unique(h, return_counts=True)
        if len(self.key) and len(key):
            at = np.minimum(np.searchsorted(key, self.key), len(key) - 1)
            hit = key[at] == self.key
            n[at[hit]] += self.n[hit]
            self.key, self.n = self.key[~hit], self.n[~hit]
        self.key, self.n = np.concatenate([self.key, key]), np.concatenate([self.n, n])
        if len(self.n) > self.most:
            # taking the same from most + 1 counters at once is so many single steps of the method
            self.n -= np.partition(self.n, -self.most - 1)[-self.most - 1]
            self.key, self.n = self.key[self.n > 0], self.n[self.n > 0]


def held_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (their last column a text) in lists of about ``BATCH_BYTES``."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    yield held


def frequent_grams(docs: DataFrame, grams: Callable[[list[bytes]], np.ndarray], heavy: int, least: int, counters: int) -> np.ndarray:
    """Sorted hashes of the frequent grams among all of ``docs``: every one with more than 1/``heavy`` of all places (and
    ``least``), and some with more than a quarter of that."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counters(counters)
        for rows in held_texts(batches):
            c.add(grams([r[0] for r in rows]))
        some = c.n > c.seen // (2 * heavy)
        key = pa.array([*c.key[some].view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([key, pa.array([*c.n[some].tolist(), c.seen], pa.int64())], ["key", "n"])

    counts = cut(docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    seen = counts.filter("key is null").first()
    if seen is None:
        return np.zeros(0, np.uint64)
    bound = max(seen["n"] / heavy, least) - seen["n"] / counters - seen["n"] / (2 * heavy)
    rows = counts.filter(F.col("key").isNotNull() & (F.col("n") > bound)).collect()  # fewer than 4 * heavy
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


class Shard:
    """The strings of one bucket, unpacked as they come: owners and places in memory, text in a temporary file if it is large."""

    def __init__(self):
        self.columns, self.parts, self.inside, self.file = ([], [], [], []), [], 0, None

    def add(self, blob: bytes) -> np.ndarray:
        """Take in a blob; the rows that it brings settled."""
        *columns, text, gone = unpack(blob)
        for have, x in zip(self.columns, columns, strict=True):
            have.append(x)
        self.parts.append(text)
        self.inside += len(text)
        if self.inside > SHARD_BYTES:
            self.file = self.file or tempfile.TemporaryFile(prefix="shard-")
            self.file.write(b"".join(self.parts))
            self.parts, self.inside = [], 0
        return gone

    def text(self) -> bytes | mmap.mmap:
        if self.file is None:
            return b"".join(self.parts)
        self.file.write(b"".join(self.parts))
        self.file.flush()
        return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


Runs = tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def find_covered(
    docs: DataFrame,
    grams: Callable[[list[bytes]], np.ndarray],
    runs: Callable[[list[bytes], np.ndarray], Runs],
    settle: Callable[..., np.ndarray],
    same_doc_counts: bool,
    reach: int,
    repeated: bool,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``doc, tag, spans``: what is covered in each row of ``docs`` (doc, tag, text as bytes).

    ``grams(texts)`` gives the hashes of all grams. ``runs(texts, frequent)`` gives a byte string and, for each run of
    windows in it, the text's number, first place, last place (of windows), and byte range, with its minimiser.
    ``settle(doc, tag, at, start, size, text, frequent)`` gets a bucket's strings, earliest owner first, and gives rows
    (doc, tag, start, end) of what an earlier owner has too. ``same_doc_counts``: whether an earlier place in the same
    document counts as earlier. Rows of equal ``doc`` and ``tag`` are one; ``repeated``: whether there may be such rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = n_tasks(spark, 3 * total, TASK_BYTES)
    buckets = max(parts * max(1, 32 * MB // bucket_bytes), 3 * total // bucket_bytes)
    bounded_batches(spark)
    frequent = frequent_grams(docs, grams, HEAVY, LEAST_PLACES, COUNTERS)
    remembered = REMEMBERED

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, int]] = {}
        for rows in held_texts(batches):
            yield from emit(list({r[:2]: r for r in rows}.values()), known)

    def emit(held: list[tuple[int, int, bytes]], known: dict[bytes, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: (r[0], r[1]))
        big, text, first, last, (start, end), least = runs([r[2] for r in held], frequent)
        if not len(text):
            return
        seen: dict[bytes, tuple[int, int, int]] = {}
        keep, strings, gone = [], [], []
        often = least >= TOP
        for k, (t, a, b, s, e, o) in enumerate(zip(*(x.tolist() for x in (text, first, last, start, end, often)), strict=True)):
            x, me = big[s:e], (*held[t][:2], a)
            owner = seen.get(x)
            if o and owner is None:
                owner = known.get(x)
                if owner is not None and owner > me:  # one that comes earlier still is sent too
                    owner = None
            if owner is None:
                seen[x] = me
                if o and (x in known or len(known) < remembered):
                    known[x] = me
            elif owner == me:
                continue
            elif same_doc_counts or owner[0] < me[0]:
                gone.append((*me[:2], a, b + reach))
                continue
            keep.append(k)
            strings.append(x)
        idx = np.array(keep, np.int64)
        doc = np.array([r[0] for r in held], np.int64)[text[idx]]
        tag = np.array([r[1] for r in held], np.int64)[text[idx]]
        at, bucket = first[idx].astype(np.int64), (least[idx] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        settled = np.array(gone, np.int64).reshape(-1, 4)
        if not len(cuts):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(doc, tag, at, [], settled)], pa.binary())], ["bucket", "blob"])
            return
        share = np.array_split(settled, len(cuts))
        ids, blobs = [], []
        for part, (i, j) in enumerate(zip(cuts, np.append(cuts[1:], len(order)), strict=True)):
            o = order[i:j]
            ids.append(int(bucket[o[0]]))
            blobs.append(pack(doc[o], tag[o], at[o], [strings[k] for k in o], share[part]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard()
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != now and now is not None:
                    yield from answer(shard)
                    shard = Shard()
                now = bucket
                yield from spans_of(shard.add(blob.as_py()))
        if now is not None:
            yield from answer(shard)

    def answer(shard: Shard) -> Iterator[pa.RecordBatch]:
        doc, tag, at, size = (np.concatenate(x) for x in shard.columns)
        if not len(doc):
            return
        # earliest owner first, each once
        start = np.cumsum(size, dtype=np.int64) - size
        order = np.lexsort((at, tag, doc))
        d, g, a = doc[order], tag[order], at[order]
        order = order[np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (a[1:] != a[:-1]))]
        yield from spans_of(settle(doc[order], tag[order], at[order], start[order], size[order], shard.text(), frequent))

    def spans_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 1 << 16):
            r = rows[k : k + (1 << 16)]
            # a span is one number: start, then end, of 32 bits each
            yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array((r[:, 2] << 32) | r[:, 3])], ["doc", "tag", "span"])

    sent = docs.select("doc", "tag", "text").mapInArrow(send, "bucket int, blob binary")
    rows = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(receive, "doc long, tag long, span long")
    # equal rows bring equal spans
    return rows.groupBy("doc", "tag").agg((F.collect_set if repeated else F.collect_list)("span").alias("spans"))


def with_spans(docs: DataFrame, find: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``doc_id, text`` (compressed bytes, see :func:`unpacked`) of each row of ``docs`` with the ``spans`` that ``find`` covers, null for none."""
    repeated, gap = id_facts(docs)
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumns(doc_key(repeated, gap)).withColumn("text", F.col("text").cast("binary"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield b.set_column(3, "text", pa.array([z.compress(x.as_py()) for x in b.column(3)], pa.binary()))

    spans = find(rows, repeated).hint("shuffle_hash")
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "doc", "tag", "text").mapInArrow(packed, "doc_id long, doc long, tag long, text binary")
    return texts.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans")


def unpacked(texts: pa.Array) -> Iterator[bytes]:
    z = zstandard.ZstdDecompressor()
    return (z.decompress(x.as_py()) for x in texts)


def mask(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of ``n`` places the spans cover."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, spans >> 32, 1)
    np.add.at(d, spans & 0xFFFFFFFF, -1)
    return np.cumsum(d[:n]) > 0
