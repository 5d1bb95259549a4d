"""Substring deduplication over windows of words, by super-k-mer partitioning (see :mod:`.superkmers`)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .superkmers import BLOCK, NONE, Hashes, demoted, find_covered, mask, sliding_min, unpacked, with_spans

WINDOW, GRAM = 13, 3
#: Windows whose words are compared at once.
COMPARED = 1 << 15


def _grams(texts: list[bytes], size: int):
    """The texts of at least ``size`` words: their numbers, all words joined, for each word its text, place, start and end
    in that, and the hash of each gram (in which of them two texts meet)."""
    split = [t.split() for t in texts]  # bytes: at \\x20 and \\x09-\\x0D only
    used = [k for k, w in enumerate(split) if len(w) >= size]
    big = b"\n".join(b" ".join(split[k]) for k in used)
    counts = np.array([len(split[k]) for k in used], np.int64)
    text = np.repeat(np.array(used, np.int64), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    a = np.frombuffer(big, np.uint8)
    gaps = np.flatnonzero((a == 32) | (a == 10))
    starts, ends = np.append(0, gaps + 1)[: len(text)], np.append(gaps, len(a))[: len(text)]
    g = max(len(text) - GRAM + 1, 0)
    gram = Hashes(a).of(starts[:g], ends[len(ends) - g :])
    return big, text, place, starts, ends, gram, text[:g] != text[len(text) - g :]


def word_grams(texts: list[bytes]) -> np.ndarray:
    """Hashes of the three-word grams that are in a window."""
    *_, gram, torn = _grams(texts, WINDOW)
    return gram[~torn]


def word_runs(texts: list[bytes], frequent: np.ndarray):
    """Runs of consecutive windows with one minimiser, over texts of words joined by one space."""
    big, text, place, starts, ends, gram, torn = _grams(texts, WINDOW)
    if not len(text):
        none = np.zeros(0, np.int64)
        return b"", none, none, none, (none, none), none.astype(np.uint64)
    gram = demoted(gram, frequent)
    gram[torn] = NONE
    n = len(starts) - WINDOW + 1
    least = sliding_min(gram, WINDOW - GRAM + 1)[:n]
    ok = text[:n] == text[WINDOW - 1 :]
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    at = np.flatnonzero(ok & fresh)
    # a run lasts until the next one begins or its text has no more windows
    bad_or_fresh = np.append(np.flatnonzero(fresh | ~ok), n)
    stop = bad_or_fresh[np.searchsorted(bad_or_fresh, at, side="right")] - 1
    return big, text[at], place[at], place[stop], (starts[at], ends[stop + WINDOW - 1]), least[at]


def _windows(text: bytes, start: np.ndarray, size: np.ndarray, own: np.ndarray):
    """All windows of some neighbouring strings: hash, first and last byte, string, and number of the first word."""
    base, stop = int(start[own[0]]), int(start[own[-1]] + size[own[-1]])
    a = np.frombuffer(text, np.uint8, stop - base, base)
    first = start[own] - base
    gaps = np.flatnonzero(a == 32)
    # a string ends where the next begins
    w_start = np.sort(np.concatenate([first, gaps + 1]))
    w_end = np.sort(np.concatenate([first + size[own], gaps]))
    which = np.searchsorted(first, w_start, side="right") - 1
    word = np.arange(len(w_start)) - np.searchsorted(w_start, first)[which]
    n = max(len(w_start) - WINDOW + 1, 0)
    win = np.flatnonzero(which[:n] == which[WINDOW - 1 :])
    s, e = w_start[win], w_end[win + WINDOW - 1]
    return Hashes(a).of(s, e), s + base, e + base, own[which[win]], word[win]


def settle(doc, tag, at, start, size, text: bytes, frequent: np.ndarray) -> np.ndarray:
    """Spans of words in windows that a smaller document has too. Sorting by hash brings equal windows together; their
    words are compared before they count as equal."""
    order = np.argsort(start)
    block = (np.cumsum(size[order], dtype=np.int64) - 1) // BLOCK
    found = [_windows(text, start, size, own) for own in np.split(order, np.flatnonzero(np.diff(block)) + 1)]
    h, s, e, o, word = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    by = np.lexsort((doc[o], h))
    h, s, e, o, word = h[by], s[by], e[by], o[by], word[by]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    lead = np.repeat(head, np.diff(np.append(head, len(h))))
    later = np.flatnonzero(doc[o] > doc[o[lead]])
    equal = np.zeros(len(later), bool)
    for k in range(0, len(later), COMPARED):
        w = later[k : k + COMPARED]
        first = lead[w]
        places = zip(s[w].tolist(), e[w].tolist(), s[first].tolist(), e[first].tolist(), strict=True)
        equal[k : k + COMPARED] = [text[a:b] == text[c:d] for a, b, c, d in places]
    more = []
    for k in later[~equal].tolist():  # another window with the same hash: look at the others of the run
        others = range(int(lead[k]) + 1, k)
        if any(text[s[x] : e[x]] == text[s[k] : e[k]] and doc[o[x]] < doc[o[k]] for x in others):
            more.append(k)
    hit = np.concatenate([later[equal], np.array(more, np.int64)])
    begin = at[o[hit]] + word[hit]
    own = o[hit]
    # neighbouring windows of one string make one span
    by = np.lexsort((begin, own))
    own, begin = own[by], begin[by]
    if not len(own):
        return np.zeros((0, 4), np.int64)
    i = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (begin[1:] > begin[:-1] + 1)))
    j = np.append(i[1:], len(own)) - 1
    return np.stack([doc[own[i]], tag[own[i]], begin[i], begin[j] + WINDOW], axis=1)


def covered(rows: DataFrame, repeated: bool) -> DataFrame:
    return find_covered(rows, word_grams, word_runs, settle, same_doc_counts=False, reach=WINDOW, repeated=repeated)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` (the text that is left).

    A word goes if a window of 13 words that covers it also starts in a document of smaller ``doc_id``; windows are those
    of the input. Null text has no words; texts under 13 words keep all; a null id counts as larger than any other; rows
    that share an id (or have none) are one document and don't count against each other; repeated rows get equal
    results. Texts and words may be of any length. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, left = [], [], [], []
            for text, spans in zip(unpacked(b.column(1)), b.column(2), strict=True):
                words = text.split()
                if spans.is_valid:
                    m = mask(len(words), spans.values.to_numpy())
                    kept = b" ".join(compress(words, (~m).tolist()))
                    gone.append(int(m.sum()))
                else:
                    kept = b" ".join(words)
                    gone.append(0)
                n.append(len(words))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(left, pa.string())] * with_text, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return with_spans(docs, covered).mapInArrow(run, schema)
