"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
import tracemalloc

import numpy as np
import xxhash

import corpus_pipeline
from hearken.llm import near_texts


def brute(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (len(x & y) >= 0.8 * len(x | y)) and top(i) != top(j):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def test_near_stage_is_exact(spark):
    """Copies with a few edited words, chains of edits, short, equal and empty texts."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "one three")]
    for base in range(30):
        own = rnd.choices(words, k=rnd.choice([20, 60, 200]))
        for _ in range(6):
            rows.append((len(rows), " ".join(own)))
            for _ in range(rnd.randrange(1, max(2, len(own) // 40 + 1))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert 30 < len(want) < len(rows) // 2
    assert sorted(r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()) == want


def test_large_buckets_hold_few_links():
    """All pairs of a bucket may be similar: links are held for each text, not for each pair."""
    n = 2500
    key, name, root = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    x, same = np.zeros((n, near_texts.SKETCH), np.uint8), np.arange(30, dtype=np.uint64)
    for links in (lambda: near_texts.agreeing(key, name, root, np.full(n, 30), x), lambda: near_texts.linked(key, name, root, [same] * n)):
        tracemalloc.start()
        a, b = links()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sorted(a) == list(range(1, n)) and (b == 0).all()
        assert peak < 16 << 20, peak


def test_links_across_roots_meet():
    """Two roots whose first texts only seem to be similar: what truly links them still shares a group of candidates."""
    key, name, root = np.zeros(4, np.int64), np.array([1, 2, 3, 4]), np.array([1, 2, 1, 2])
    x = np.zeros((4, near_texts.SKETCH), np.uint8)
    x[2:] = 1
    a, b = near_texts.agreeing(key, name, root, np.full(4, 30), x)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (4, 3)]


def edited(seed):
    """Texts with one word of 300 changed and such with many, and their fingerprints by a plain model."""
    rnd = random.Random(seed)
    words, rows = [f"w{i}" for i in range(500)], []
    for _ in range(12):
        own = rnd.choices(words, k=300)
        for n in (0, 1, 1, 9):
            for _ in range(n):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((len(rows), " ".join(own)))

    def fp(t):
        w = t.encode().split()
        hs = [xxhash.xxh64_intdigest(x, 42) for x in {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    return rows, {d: fp(t) for d, t in rows}


def test_near_fingerprints_are_joined_by_simhash(spark, monkeypatch):
    """Without the prefix filter the groups of near fingerprints are still joined, and with it the rest, too."""
    rows, fps = edited(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = {d: d for d in fps}
    for d in fps:
        for e in range(d):
            if (fps[d] ^ fps[e]).bit_count() <= 3:
                group = {k: min(group[d], group[e]) if g in (group[d], group[e]) else g for k, g in group.items()}
    want = sorted(set(group.values()))
    whole = brute(rows)
    assert len(whole) < len(want) < len(rows)
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect())
    assert kept() == whole
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_texts, "_sketched", lambda *_: none)
    monkeypatch.setattr(near_texts, "_apart_links", lambda *_: none)
    assert kept() == want


def test_groups_of_fingerprints_are_verified(spark, monkeypatch):
    """All fingerprints are equal: what is not similar is kept, and what is similar to another one than the first still goes."""
    monkeypatch.setattr(near_texts, "majority", lambda counts, n: 0)
    rows, _ = edited(9)
    rows = [*rows, (100, None), (101, " "), (102, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()) == brute(rows)
