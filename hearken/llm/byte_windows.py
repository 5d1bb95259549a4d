"""Substring deduplication over bytes with suffix arrays.

Every 100-byte string goes to a shard with its minimiser (see :mod:`.superkmers`), as part of a run of neighbouring
ones. A shard settles repeats of whole runs and, of those that share a minimiser, of the pieces whose strings may have an
equal one, then sorts the suffixes of what is left by external induced sorting (:mod:`.suffix_sort`): suffixes with 100 common symbols are neighbours and the earliest one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .suffix_sort import MEMORY, equal_groups, room
from .superkmers import BLOCK, GRAM, K1, MB, NONE, Hashes, demoted, find_covered, gram_hashes, mixed, mask, sliding_min, unpacked, with_spans, words_at

LENGTH = 100
#: What is not the minimiser in steps of bytes: two equal strings share all but one step of it, some on the left, the rest on the right.
STEP = 11
STEPS = (LENGTH - GRAM) // STEP
#: Packed strings of a bucket, and of the parts of it that are settled at once.
BUCKET_BYTES, PART_BYTES = 16 * MB, 6 * MB


def byte_grams(texts: list[bytes]) -> np.ndarray:
    """Hashes of the grams that are in a 100-byte string, and of some that two texts share."""
    return gram_hashes(np.frombuffer(b"".join([t for t in texts if len(t) >= LENGTH]), np.uint8))


def byte_runs(texts: list[bytes], frequent: np.ndarray):
    """Runs of consecutive 100-byte strings with one minimiser."""
    used = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    big = b"".join(texts[k] for k in used)
    size = np.array([len(texts[k]) for k in used], np.int64)
    if not len(used):
        none = np.zeros(0, np.int64)
        return b"", none, none, none, (none, none), none.astype(np.uint64)
    a = np.frombuffer(big, np.uint8)
    end = np.cumsum(size)
    n = len(a) - LENGTH + 1
    least = sliding_min(demoted(gram_hashes(a), frequent), LENGTH - GRAM + 1)[:n]
    # the last 99 places of each text start no string
    edge = np.zeros(len(a) + 1, np.int8)
    edge[end - LENGTH + 1] += 1
    edge[end] -= 1
    ok = np.cumsum(edge[:n], dtype=np.int8) == 0
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    at = np.flatnonzero(ok & fresh)
    bad_or_fresh = np.append(np.flatnonzero(fresh | ~ok), n)
    stop = bad_or_fresh[np.searchsorted(bad_or_fresh, at, side="right")] - 1
    which = np.searchsorted(end, at, side="right")
    begin = (end - size)[which]
    return big, np.array(used)[which], at - begin, stop - begin, (at, stop + LENGTH), least[at]


def _grams_of(a: np.ndarray, s: np.ndarray, n: np.ndarray, frequent: np.ndarray):
    """For each string its minimiser, and for each place where it stands there (``own``: the string's number) ``STEPS`` hashes of it
    with 0, 1, ... steps to its left and the others, but one, to its right (zero where there are fewer). A block of strings at a time."""
    least = np.empty(len(s), np.uint64)
    got: list[tuple[np.ndarray, np.ndarray]] = []

    def chained(w: np.ndarray, places: np.ndarray, begin: np.ndarray, end: np.ndarray, to: int) -> list[np.ndarray]:
        """Hashes of 0, 1, ... steps next to the grams at ``places``, zero where these leave ``begin`` to ``end``."""
        out = [np.ones(len(places), np.uint64)]
        for k in range(1, STEPS):
            at = places - k * STEP if to < 0 else places + GRAM + (k - 1) * STEP
            ok = (at >= begin) & (at + STEP <= end)
            h = np.zeros(len(places), np.uint64)
            h[ok] = mixed(mixed(out[-1][ok] ^ w[at[ok]]) * K1 + w[at[ok] + STEP - 8]) | np.uint64(1)
            out.append(h)
        return out

    by = np.argsort(s)
    block = (np.cumsum(n[by]) - 1) // BLOCK
    for own in np.split(by, np.flatnonzero(np.diff(block)) + 1):
        begin, end = int(s[own[0]]), int(s[own[-1]] + n[own[-1]])
        part = a[begin:end]
        w = words_at(part)
        grams = np.append(demoted(gram_hashes(part, w), frequent), NONE)
        bounds = np.stack([s[own], s[own] + n[own] - GRAM + 1], axis=1).ravel() - begin
        found = np.minimum.reduceat(grams, bounds)
        hit = grams == np.repeat(found, np.diff(np.append(bounds, len(grams))))
        least[own] = found[::2]
        places = np.flatnonzero(hit)
        where = np.searchsorted(bounds, places, side="right") - 1
        # odd ones lie between two strings
        places, where = places[where % 2 == 0], where[where % 2 == 0]
        begin, end = bounds[where], bounds[where] + n[own[where // 2]]
        left, right = (chained(w, places, begin, end, to) for to in (-1, 1))
        keys = np.empty((STEPS, len(places)), np.uint32)
        for k in range(STEPS):
            x, y = left[k], right[STEPS - 1 - k]
            keys[k] = np.where((x != 0) & (y != 0), mixed((x ^ grams[places]) * K1 + y) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        got.append((own[where // 2], keys))
    return least, np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got], axis=1)


def _several(x: np.ndarray) -> np.ndarray:
    _, which, counts = np.unique(x, return_inverse=True, return_counts=True)
    return counts[which] > 1


def _in_blocks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of strings of these sizes, about ``BLOCK`` bytes at a time."""
    return iter(np.split(np.arange(len(size)), np.flatnonzero(np.diff((np.cumsum(size) - size) // BLOCK)) + 1))


def _met_again(run: np.ndarray, s: np.ndarray, n: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings ``s, n`` of runs cut down to the 100-byte strings whose hash stands in them at several places."""
    hashes = []
    for o in _in_blocks(n):
        h = Hashes(np.frombuffer(b"".join([text[x : x + m] for x, m in zip(s[o].tolist(), n[o].tolist(), strict=True)]), np.uint8))
        count = n[o] - LENGTH + 1
        i = np.repeat(np.cumsum(n[o]) - n[o] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        hashes.append((h.of(i, i + LENGTH) >> np.uint64(32)).astype(np.uint32))
    h = np.concatenate(hashes)
    order = np.argsort(h)
    x = h[order]
    same = x[1:] == x[:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    count = n - LENGTH + 1
    begin = np.cumsum(count) - count
    first = np.zeros(len(h), bool)
    first[begin] = True
    i = np.flatnonzero(again & (first | ~np.append(False, again[:-1])))
    j = np.flatnonzero(again & np.append(first[1:] | ~again[1:], True)) + 1
    own = np.searchsorted(begin, i, side="right") - 1
    return run[own], s[own] + i - begin[own], j - i + LENGTH - 1


def settle(doc, tag, at, start, size, text: bytes, frequent: np.ndarray) -> np.ndarray:
    """Spans of bytes under strings that start earlier too. The runs stand in the order of their owners."""
    a = np.frombuffer(text, np.uint8)
    least, own, keys = _grams_of(a, start, size.astype(np.int64), frequent)
    parts = max(1, len(text) // PART_BYTES)
    part = (least // np.uint64(parts)) % np.uint64(parts)
    return np.concatenate([_settle_part(np.flatnonzero(part == p), own, keys, doc, tag, at, start, size, text) for p in range(parts)])


def _settle_part(k, own, keys, doc, tag, at, start, size, text: bytes) -> np.ndarray:
    """The same for runs ``k``, among which are all that share a minimiser with one of them."""
    fresh = np.ones(len(k), bool)
    if int(size[k].sum()) <= 2 * PART_BYTES:  # beyond that copies of whole runs are found by the sorting only
        seen: set[bytes] = set()
        for i, (s, n) in enumerate(zip(start[k].tolist(), size[k].tolist(), strict=True)):
            x = text[s : s + n]
            fresh[i] = x not in seen
            seen.add(x)
        del seen
    copies, k = k[~fresh], k[fresh]
    gone = [np.stack([doc[copies], tag[copies], at[copies], at[copies] + size[copies]], axis=1)]
    # two equal strings share their minimiser and whole steps next to it, all but one, at the place where it stands first in
    # them, which may be any of its places in their runs; a run that shares none of these hashes needs no sorting
    inside = np.zeros(len(start), bool)
    inside[k] = True
    among = np.flatnonzero(inside[own])
    inside[:] = False
    for x in keys:
        x = x[among]
        inside[own[among[_several(x) & (x > 0)]]] = True
    k = k[inside[k]]
    if not len(k):
        return gone[0]
    s, n = start[k], size[k].astype(np.int64)
    # of what is left only strings that may have an equal one are sorted, and of pieces that are the same thereby the first one
    while len(k) and int(n.sum()) <= MEMORY:  # larger parts are sorted whole
        before = int(n.sum())
        k, s, n = _met_again(k, s, n, text)
        seen, fresh = set(), np.ones(len(k), bool)
        for i, (b, m) in enumerate(zip(s.tolist(), n.tolist(), strict=True)):
            x = text[b : b + m]
            fresh[i] = x not in seen
            seen.add(x)
        del seen
        o, begin = k[~fresh], (at[k] + s - start[k])[~fresh]
        gone.append(np.stack([doc[o], tag[o], begin, begin + n[~fresh]], axis=1))
        k, s, n = k[fresh], s[fresh], n[fresh]
        if fresh.all() or int(n.sum()) > 0.9 * before:
            break
    if not len(k):
        return np.concatenate(gone)
    place = at[k] + s - start[k]
    first = np.cumsum(n + 1) - n - 1
    # symbols: byte + 2; 1 between strings, 0 at the end
    t, valid = room(int(n.sum()) + len(n) + 1, np.uint16, MEMORY, 1), room(int(n.sum()) + len(n) + 1, bool, MEMORY, False)
    t[-1] = 0
    for o in np.split(np.arange(len(k)), np.flatnonzero(np.diff(first // BLOCK)) + 1):
        i, j = int(first[o[0]]), int(first[o[-1]] + n[o[-1]] + 1)
        joined = b"\0".join([text[x : x + m] for x, m in zip(s[o].tolist(), n[o].tolist(), strict=True)])
        part = np.frombuffer(joined, np.uint8).astype(np.uint16) + 2
        part[(first[o[1:]] - 1 - i)] = 1
        t[i : j - 1] = part
        edge = np.zeros(j - i, np.int8)
        edge[first[o] - i] += 1
        edge[first[o] - i + n[o] - LENGTH + 1] -= 1
        valid[i:j] = np.cumsum(edge, dtype=np.int8) > 0
    # chunks come in the order of the suffixes; neighbouring places meet only when all are known
    covered_at = room(len(t), bool, MEMORY, False)
    for rows in equal_groups(t, LENGTH, valid):
        covered_at[rows[:, 0]] = True
    for x in range(0, len(t), BLOCK):
        p = np.flatnonzero(covered_at[x : x + BLOCK]) + x
        if not len(p):
            continue
        o = np.searchsorted(first, p, side="right") - 1
        i = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)))
        j = np.append(i[1:], len(p)) - 1
        own, begin = k[o[i]], place[o[i]] - first[o[i]]
        gone.append(np.stack([doc[own], tag[own], begin + p[i], begin + p[j] + LENGTH], axis=1))
    return np.concatenate(gone)


def covered(rows: DataFrame, repeated: bool) -> DataFrame:
    return find_covered(rows, byte_grams, byte_runs, settle, same_doc_counts=True, reach=LENGTH, repeated=repeated, bucket_bytes=BUCKET_BYTES)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the bytes that are left).

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller ``doc_id`` or at an
    earlier place of the same one; strings are those of the input and never cross documents. Null text is empty; texts
    under 100 bytes stay whole; a null id counts as larger than any other. Rows that share an id (or have none) count as
    one document, the row of the smaller text hash first; rows that are equal in id and text are the same row and get equal
    results. Texts may be of any length. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, runs, sha, left = [], [], [], [], []
            for text, spans in zip(unpacked(b.column(1)), b.column(2), strict=True):
                kept = text
                g = r = 0
                if spans.is_valid:
                    m = mask(len(text), spans.values.to_numpy())
                    g, r = int(m.sum()), int(m[0]) + int((m[1:] & ~m[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~m].tobytes()
                n.append(len(text))
                gone.append(g)
                runs.append(r)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept)
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(left, pa.binary())] * with_text, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return with_spans(docs, covered).mapInArrow(run, schema)
