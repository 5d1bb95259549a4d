"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from hearken.llm import spelling

DOCS = "doc_id long, text string, word string, n int, key string, wid long, root string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            x = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if x % 199 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    close = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n), key=repr)


def rows_of(rnd):
    """Chains of variants of falling counts, repeated letters, ties, words around and beyond the length that is turned as digests."""
    words = Counter()
    for base in ["aabbaa", "aaaaaa", "banana", "château", "ÀÉxyzw", "mississippi", "abcdefgh", "abcdefghi", "q" * 9, "".join(rnd.choice("abc") for _ in range(40)), "z" * 5000]:
        now, n = base, rnd.choice([400, 700])
        while n >= 4:
            words[now] += n
            for _ in range(3):
                k = rnd.randrange(len(now))
                words[rnd.choice([now[:k] + now[k + 1 :], now[:k] + "a" + now[k:], now[:k] + "é" + now[k + 1 :]])] += rnd.choice([5, 5, 6, n // 2])
            k, n = rnd.randrange(len(now)), n // 6
            now = rnd.choice([now[:k] + now[k + 1 :], now[:k] + now[k] + now[k:], now[:k] + "b" + now[k + 1 :]])
    flat = [w.upper() if rnd.random() < 0.1 and w.isascii() else w for w, n in words.items() for _ in range(n if len(w) < 1000 else min(n, 40))]
    rnd.shuffle(flat)
    docs = [(k, rnd.choice([" ", "1", ", "]).join(flat[k :: 120])) for k in range(120)]
    return docs + [(None, None), (None, "aabbaa aabbaa"), (3, ""), (4, "1234 _"), (5, docs[5][1])]


@pytest.mark.parametrize("long", [64, 8])
def test_variants_equal_a_plain_comparison(spark, monkeypatch, long):
    monkeypatch.setattr(spelling, "LONG", long)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "PIECE", 1000)
    docs = rows_of(random.Random(long))
    out = spelling.variants(spark.createDataFrame([(*r, "w", 1, "k", 2, "r") for r in docs], DOCS).repartition(3))
    got = sorted((tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    want = plain(docs)
    assert got == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want) and any(len(r[0]) > 1000 and r[4] for r in want)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "only once words here", "w", 1, "k", 2, "r")], DOCS)).count() == 0
