"""Exact, byte-window, word-window and SimHash deduplication against brute force, with edge rows."""

import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearken.llm import byte_windows, exact_dedup, simhash, suffix_sort, superkmers, word_windows
from hearken.llm import components as components_module
from hearken.llm.components import components

NONE = np.zeros(0, np.uint64)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, _row long"


def docs(spark, rows):
    """Rows of (doc_id, text), with null and clashing columns beside them."""
    return spark.createDataFrame([(d, t, None, "s", None, "clash", 7) for d, t in rows], DOCS)


def corpus(seed=1):
    """Copies, near copies, shared passages, repeats within a text, empty, null and long texts, a hot group."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijéß") for _ in range(rnd.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, hot = text(60), text(40)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "a " * 300), (4, "a " * 200 + "b"), (5, "x" * 700), (6, "x" * 99), (7, "x" * 100), (8, text(4000)), (9, "é" * 60)]
    for d in range(10, 90):
        kind = rnd.randrange(5)
        if kind == 0:
            rows.append((d, hot))
        elif kind == 1:
            rows.append((d, text(20) + " " + passage + "\n" + text(rnd.randrange(30))))
        elif kind == 2:
            other = rnd.choice(rows)[1] or ""
            cut = rnd.randrange(len(other) + 1)
            rows.append((d, other[:cut] + "ZZ " + other[cut:]))
        elif kind == 3:
            own = text(25)
            rows.append((d, f"{own} {own}\t{own}"))
        else:
            rows.append((d, text(rnd.randrange(80))))
    rnd.shuffle(rows)
    return rows


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                m[i : i + length] = b"\1" * length
            seen.add(k)
        kept = bytes(c for c, g in zip(b, m, strict=True) if not g)
        out[d] = (len(b), sum(m), sum(1 for i in range(len(b)) if m[i] and not (i and m[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, n=13):
    first, out = {}, {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(d, first.get(k, d))
    for d, w in split.items():
        m = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                m[i : i + n] = [True] * n
        out[d] = (len(w), sum(m), hashlib.sha256(b" ".join(x for x, g in zip(w, m, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_windows(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in byte_windows.dedup(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in word_windows.dedup(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_words(rows)


def test_what_is_left(spark):
    p = " ".join(f"w{i}" for i in range(20))
    d = docs(spark, [(1, p), (2, f"new {p} end")])
    assert {r.doc_id: r.kept for r in word_windows.dedup(d, with_text=True).collect()} == {1: p, 2: "new end"}
    long = p * 3
    assert {r.doc_id: bytes(r.kept) for r in byte_windows.dedup(docs(spark, [(1, long), (2, "ab" + long)]), with_text=True).collect()}[2] == b"ab"


def test_repeated_minimiser_against_single_one():
    """A short line that stands twice in one document and once before the same text in another."""
    removed = 0
    for seed in range(60):
        rng = random.Random(seed)
        p1, p2, line, rest = ("".join(rng.choices("abcdefghij ", k=n)).encode() for n in (150, 150, 60, 90))
        texts = [p1 + line + line + rest, p2 + line + rest]
        big, text, first, _, (begin, end), _ = byte_windows.byte_runs(texts, NONE)
        strings = [big[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        size = (end - begin).astype(np.int32)
        start = np.cumsum(size, dtype=np.int64) - size
        spans = byte_windows.settle(text.astype(np.int64), np.zeros(len(text), np.int64), first.astype(np.int64), start, size, b"".join(strings), NONE)
        got = [np.zeros(len(t), bool) for t in texts]
        for doc, _, i, j in spans.tolist():
            got[doc][i:j] = True
        want = brute_bytes([(d, t.decode()) for d, t in enumerate(texts)])
        for d, t in enumerate(texts):
            assert hashlib.sha256(np.frombuffer(t, np.uint8)[~got[d]].tobytes()).hexdigest() == want[d][3], (seed, d)
        removed += int(got[1].sum())
    assert removed >= 60 * 150


def test_spans_are_whole_whatever_the_chunks(monkeypatch):
    """Chunks of the sorting hold places from all over the text; a run is one span all the same."""
    monkeypatch.setattr(suffix_sort, "CHUNK", 64)
    text = "".join(random.Random(3).choices("abcdefgh", k=3000)).encode()
    size = np.array([len(text), len(text) + 1], np.int32)
    ids, none = np.array([1, 2]), np.zeros(2, np.int64)
    spans = byte_windows.settle(ids, none, none, np.array([0, len(text)]), size, text + text + b"z", NONE)
    assert spans.tolist() == [[2, 0, 0, len(text)]]


def phrased(n, pool, phrase, own, seed=3):
    """One shard of ``n`` texts of phrases from a pool, each between letters of the text's own; every tenth text holds a copy."""
    rnd = random.Random(seed)
    letters = lambda k: bytes(rnd.choices(range(97, 123), k=k))
    phrases = [letters(phrase) for _ in range(pool)]
    texts = [b"".join(letters(own) + rnd.choice(phrases) for _ in range(4)) for _ in range(n)]
    for k in range(10, n, 10):
        texts[k] += texts[k - 7][30:200]
    big, text, first, _, (begin, end), _ = byte_windows.byte_runs(texts, NONE)
    strings = [big[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    size = np.array([len(x) for x in strings], np.int32)
    start = np.cumsum(size, dtype=np.int64) - size
    return texts, (text.astype(np.int64), np.zeros(len(text), np.int64), first.astype(np.int64), start, size, b"".join(strings), NONE)


def test_phrases_shorter_than_a_string_are_not_sorted(monkeypatch):
    """Phrases of 80 bytes that many texts share are no repeats of 100 bytes: only real repeats are sorted, and all are found."""
    texts, shard = phrased(400, 40, 80, 60)
    seen, want = {}, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 99):
            if seen.setdefault(t[i : i + 100], (d, i)) != (d, i):
                want.setdefault(d, set()).update(range(i, i + 100))
    symbols, sort = [], byte_windows.equal_groups
    monkeypatch.setattr(byte_windows, "equal_groups", lambda t, *a: (symbols.append(len(t)), sort(t, *a))[1])
    got = {}
    for d, _, i, j in byte_windows.settle(*shard).tolist():
        got.setdefault(d, set()).update(range(i, j))
    assert got == want and len(want) == 39
    assert sum(symbols) < len(shard[5]) / 4, (symbols, len(shard[5]))


@pytest.mark.parametrize("phrase", [95, 110, 300])
def test_only_strings_that_may_have_an_equal_one_are_sorted(monkeypatch, phrase):
    """Where texts go on differently after common phrases, most of their runs hold few repeats; sorting whole parts finds the same."""
    texts, shard = phrased(400, 40, phrase, 60)
    seen, want = {}, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 99):
            if seen.setdefault(t[i : i + 100], (d, i)) != (d, i):
                want.setdefault(d, set()).update(range(i, i + 100))
    symbols, sort = [], byte_windows.equal_groups
    monkeypatch.setattr(byte_windows, "equal_groups", lambda t, *a: (symbols.append(len(t)), sort(t, *a))[1])

    def found():
        got = {}
        for d, _, i, j in byte_windows.settle(*shard).tolist():
            got.setdefault(d, set()).update(range(i, j))
        return got

    assert found() == want
    assert sum(symbols) < len(shard[5]) / 6, (symbols, len(shard[5]))
    monkeypatch.setattr(suffix_sort, "CHUNK", 4096)
    monkeypatch.setattr(byte_windows, "MEMORY", 1)  # larger parts aren't cut down, and are on disk
    assert found() == want
    assert sum(symbols) > len(shard[5]) / 6


@pytest.mark.parametrize("op", [byte_windows.dedup, word_windows.dedup, exact_dedup.exact_groups, exact_dedup.drop_copies, simhash.near_groups, simhash.one_of_each])
def test_empty_tables_and_null_ids(spark, op):
    assert op(docs(spark, [])).count() == 0
    assert op(docs(spark, [(None, "alpha " * 40), (1, "alpha " * 40), (None, None)])).count() in (2, 3)


def test_rows_that_share_an_id(spark):
    p = " ".join(f"w{i}" for i in range(30))
    got = [r.n_removed for r in word_windows.dedup(docs(spark, [(1, p), (1, p), (1, "x " + p)])).collect()]
    assert got == [0, 0, 0]


@pytest.mark.parametrize("op, brute", [(byte_windows.dedup, brute_bytes), (word_windows.dedup, brute_words)])
@pytest.mark.parametrize("back", [False, True])
def test_repeated_rows(spark, op, brute, back):
    """Rows repeated with id and text, ids shared by different texts, null ids: equal rows are one, equal ids one document."""
    rnd = random.Random(3)
    rows = sorted(corpus(5), key=lambda r: r[0])[:40]
    rows += rnd.choices(rows, k=15) + [(rnd.randrange(40), t) for _, t in rnd.choices(rows, k=12)]
    rows += [(None, t) for _, t in rnd.choices(rows, k=6)] * 3 + [(-3, "q" * 250)] * 3
    rows = rows[::-1] if back else rows
    tag = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    order = sorted({(d is None, d or 0, tag(t), t or "") for d, t in rows})
    if op is byte_windows.dedup:
        want = brute([(n, t) for n, (*_, t) in enumerate(order)])
        want = {order[n]: w for n, w in want.items()}
        got = sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in op(docs(spark, rows).repartition(5, F.rand(1))).collect())
        assert got == sorted((d is None, d or 0, *want[d is None, d or 0, tag(t), t or ""]) for d, t in rows)
    else:
        first = {}
        for null, d, _, t in order:
            w = t.split()
            for i in range(len(w) - 12):
                first.setdefault(tuple(w[i : i + 13]), (null, d))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in op(docs(spark, rows)).collect())
        want = []
        for d, t in rows:
            w = (t or "").split()
            m = [any(first[tuple(w[i : i + 13])] < (d is None, d or 0) for i in range(max(0, j - 12), min(j, len(w) - 13) + 1)) for j in range(len(w))]
            want.append((d is None, d or 0, len(w), sum(m)))
        assert got == sorted(want)


@pytest.mark.parametrize("op, brute", [(byte_windows.dedup, brute_bytes), (word_windows.dedup, brute_words)])
@pytest.mark.parametrize("beside", [[], [(2**63 - 2, "y"), (2**63 - 3, "z")]])
def test_no_id_beside_the_extreme_ids(spark, op, brute, beside):
    """A row without an id comes after that of the largest long and is another document."""
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    shared, late = text(40), text(30)
    rows = [(None, f"{text(90)} {late} {shared}"), (2**63 - 1, f"{text(50)} {shared} {late}"), (-(2**63), f"{shared} {text(20)}"), (5, text(60)), *[(d, f"{text(15)} {late} {t}") for d, t in beside]]
    got = {r.doc_id: tuple(r)[1:] for r in op(docs(spark, rows)).collect()}
    want = brute([(2**63 if d is None else d, t) for d, t in rows])
    assert got == {None if d == 2**63 else d: v for d, v in want.items()}
    assert got[None][1] > 0 and got[-(2**63)][1] == 0


@pytest.mark.parametrize("op, brute", [(byte_windows.dedup, brute_bytes), (word_windows.dedup, brute_words)])
def test_frequent_grams_and_shards_on_disk(spark, monkeypatch, op, brute):
    """A passage of many documents between their own words, with nearly every gram frequent and shards that don't fit."""
    monkeypatch.setattr(superkmers, "HEAVY", 200)
    monkeypatch.setattr(superkmers, "LEAST_PLACES", 20)
    monkeypatch.setattr(superkmers, "COUNTERS", 800)
    monkeypatch.setattr(superkmers, "REMEMBERED", 3)
    monkeypatch.setattr(superkmers, "BATCH_BYTES", 900)
    monkeypatch.setattr(superkmers, "SHARD_BYTES", 500)
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 9))) for _ in range(n))
    hot, line = text(30), text(9)
    rows = [(d, f"{text(rnd.randrange(9))} {hot if d % 3 == 0 else line} {text(rnd.randrange(25))}") for d in range(90)]
    rows += [(100 + d, hot) for d in range(20)]
    rnd.shuffle(rows)
    d = docs(spark, rows).repartition(3)
    keyed = d.select(F.col("text").cast("binary").alias("text"))
    grams = byte_windows.byte_grams if op is byte_windows.dedup else word_windows.word_grams
    assert len(superkmers.frequent_grams(keyed, grams, 200, 20, 800)) > 20
    got = {r.doc_id: tuple(r)[1:] for r in op(d).collect()}
    assert got == brute(rows)


def test_counters_name_all_that_is_frequent():
    rng = np.random.default_rng(1)
    c, every = superkmers.Counters(50), []
    for _ in range(40):
        h = np.concatenate([rng.integers(0, 1 << 60, 300), rng.integers(0, 9, 100)]).astype(np.uint64)
        every.append(h)
        c.add(h)
    key, n = np.unique(np.concatenate(every), return_counts=True)
    have = dict(zip(c.key.tolist(), c.n.tolist(), strict=True))
    assert c.seen == 16000 and len(have) <= 50
    assert all(k - c.seen / 50 <= have.get(x, 0) <= k for x, k in zip(key.tolist(), n.tolist(), strict=True))
    h = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    low = superkmers.demoted(h, np.sort(h[::7]))
    assert (np.flatnonzero(low >= superkmers.TOP) == np.arange(0, 1000, 7)).all()


OUTER = """
import sys
import numpy as np
from hearken.llm import suffix_sort
suffix_sort.CHUNK = 1 << 14
status = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1])
rng = np.random.default_rng(2)
base = rng.integers(0, 3, 40_000).astype(np.uint16) + 2
memory, copies = int(sys.argv[1]), 24
t = suffix_sort.on_disk(copies * 40_001 + 1, np.uint16)
valid = suffix_sort.on_disk(len(t), bool)
valid[:] = False
for k in range(copies):
    x = base.copy()
    x[rng.integers(0, 40_000, 20)] = 2
    t[k * 40_001 : k * 40_001 + 40_000] = x
    t[k * 40_001 + 40_000] = 1
    valid[k * 40_001 : k * 40_001 + 40_000 - 99] = True
t[-1] = 0
before, most, found, total = status(), 0, 0, 0
for rows in suffix_sort.equal_groups(t, 100, valid, memory, 1 << 12):
    most, found, total = max(most, status() - before), found + len(rows), total + int((rows[:, 0] ^ rows[:, 1]).sum())
raw, first, n, s = t.tobytes(), {}, 0, 0
for i in np.flatnonzero(valid).tolist():
    j = first.setdefault(raw[2 * i : 2 * i + 200], i)
    n, s = n + (i != j), s + (i ^ j if i != j else 0)
assert (found, total) == (n, s), (found, n)
print(most)
"""


def test_a_shard_larger_than_memory():
    """About a million suffixes with room for 2 ** 16 entries an array: anonymous memory stays far below that of the arrays."""
    run = lambda memory: int(subprocess.run([sys.executable, "-c", OUTER, str(memory)], capture_output=True, text=True, check=True).stdout)
    outer, inner = run(1 << 16), run(1 << 24)
    assert outer < 40_000 and outer < inner / 3, (outer, inner)


@pytest.mark.parametrize("memory, small, chunk", [(5, 2, 3), (50, 8, 7), (10**6, 10**6, 1000)])
def test_suffix_sorting_on_disk_and_in_recursion(memory, small, chunk, monkeypatch):
    monkeypatch.setattr(suffix_sort, "CHUNK", chunk)
    rnd = random.Random(9)
    for _ in range(60):
        n, letters = rnd.choice([2, 3, 5, 10]), rnd.choice([1, 2, 3, 20])
        parts = [[rnd.randrange(letters) + 2 for _ in range(rnd.randrange(40))] for _ in range(rnd.randrange(1, 12))]
        parts += [list(rnd.choice(parts)) for _ in range(2)]
        t, valid = [], []
        for p in parts:
            t += [*p, 1]
            valid += [i + n <= len(p) for i in range(len(p))] + [False]
        t, valid = np.array([*t, 0], np.uint16), np.array([*valid, False])
        first, want = {}, set()
        for i in np.flatnonzero(valid).tolist():
            k = tuple(t[i : i + n].tolist())
            if k in first:
                want.add((i, first[k]))
            first.setdefault(k, i)
        got = [tuple(r) for c in suffix_sort.equal_groups(t, n, valid, memory, small) for r in c.tolist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_slices_hash_alike_wherever_they_stand():
    a, b = np.frombuffer(b"xxabcdyy", np.uint8), np.frombuffer(b"abcd" + b"z" * 2_000_000, np.uint8)
    one = lambda x, i, j: superkmers.Hashes(x).of(np.array([i]), np.array([j]))[0]
    assert one(a, 2, 6) == one(b, 0, 4) != one(a, 1, 5)
    c = np.frombuffer(bytes(range(40)) + bytes(range(3, 25)), np.uint8)
    g = superkmers.gram_hashes(c)
    assert len(g) == 51 and len(set(g.tolist())) == 51 - 11 and (g[3:14] == g[40:51]).all() and not len(superkmers.gram_hashes(c[:11]))
    h = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    assert (superkmers.sliding_min(h, 7) == [h[i : i + 7].min() for i in range(44)]).all()


def test_exact_groups(spark):
    rows = [(5, "same"), (9, "same"), (7, "same"), (1, None), (2, ""), (3, "Same"), (4, "é"), (6, "é")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[5] == (9, 3, False, sha("same")) and got[9][2] and got[1] == (2, 2, False, sha("")) and got[3] == (3, 1, True, sha("Same")) and got[4][0] == 6
    kept = exact_dedup.drop_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 9] and kept.columns == docs(spark, []).columns


def test_heavy_groups_and_repeated_rows(spark):
    d = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    d = d.select(F.col("id").alias("doc_id"), "text").unionByName(d.filter("id = 5997").select(F.col("id").alias("doc_id"), "text"))
    got = exact_dedup.exact_groups(d)
    assert got.count() == 6001 and got.filter("kept").count() == d.select("text").distinct().count()
    hot = got.filter(F.col("text_sha256") == F.sha2(F.lit("hot").cast("binary"), 256))
    assert hot.select("keep_id", "group_size").distinct().collect() == [(5997, 2001)] and hot.filter("kept").count() == 1
    assert exact_dedup.drop_copies(d).count() == d.select("text").distinct().count()


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\tÄx", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fp(text)


def brute_components(fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_groups(spark):
    rows = sorted(corpus(4))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs(spark, rows)).collect()}
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_components(fps)
    assert got == {d: (f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, roots, strict=True)}
    stay = {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert stay == {rows[r][0] for r in roots}


@pytest.mark.parametrize("bucket, spread", [(2048, 64), (4, 12), (1, 64)])
def test_links_lose_none(spark, monkeypatch, bucket, spread):
    """Chains and tight clusters, with buckets so small that both splits come into play."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(bucket)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        f = rnd.choice(fps)
        for _ in range(rnd.randrange(1, 5)):
            f ^= 1 << rnd.randrange(spread)
        fps.append(f)
    fps = sorted(set(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    got, want = {}, {}
    for f, r in zip(fps, brute_components(fps), strict=True):
        got.setdefault(found.get(signed(f), signed(f)), set()).add(f)
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_cover_the_distance():
    flat = [np.ones(1 << 16)] * 4
    hot = np.ones(1 << 16)
    hot[5] = 1e7
    for hist in (flat, [hot, *flat[1:]], [hot, hot, hot, flat[0]]):
        assert sum(t + 1 for t in simhash.thresholds(hist)) == 4
    assert simhash.thresholds([hot, *flat[1:]])[0] == -1
    c = np.random.default_rng(0).integers(0, 3, 1 << 16).astype(float)
    near = simhash.near_counts(c, 3)
    dist = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16) ^ np.uint16(77))
    assert [round(near[d][77]) for d in range(4)] == [round(c[dist == d].sum()) for d in range(4)]


@pytest.mark.parametrize("degree", [256, 3])
def test_components(spark, monkeypatch, degree):
    monkeypatch.setattr(components_module, "LEAST_DEGREE", degree)
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50, **{200 + i: 200 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_need_few_jobs(spark, monkeypatch):
    """A chain of any length takes the same jobs; the rounds, for larger graphs, give the same components."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 30)], "a long, b long")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = sorted(components(edges).collect())
    assert jobs() - before <= 12
    assert got == [(i, 0) for i in range(301)] + [(1000 + i, 1000) for i in range(30)]
    monkeypatch.setattr(components_module, "FEW_LINKS", 0)
    assert sorted(components(edges).collect()) == got
