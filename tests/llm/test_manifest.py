"""Merkle manifest against a plain recursive tree, and its queue."""

import heapq
import random
import zlib
from hashlib import sha256

import pytest

from hearken.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, g string, digest string, path string, block int"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf_of(row):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    d, text, lang, source, n = row[:5]
    return h("".join(enc(v) for v in (d, source, lang, n, text)))


def tree(leaves, arity):
    """Root, and for each leaf the (left, right) siblings, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for k, i in enumerate(at):
            run, j = runs[i // arity], i % arity
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[k] = i // arity
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows, arity):
    order = lambda v: (v is not None, v if v is not None else 0)
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by_source[s], key=lambda r: (order(r[0]), leaf_of(r))) for s in sources}
    trees = {s: tree([leaf_of(r) for r in own[s]], arity) for s in sources}
    root, upper = tree([trees[s][0] for s in sources], arity)
    for s, up in zip(sources, upper, strict=True):
        subroot, paths = trees[s]
        for r, path in zip(own[s], paths, strict=True):
            siblings = path + up
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
            x = leaf_of((r[0], low if touched else r[1], *r[2:]))
            for a, b in siblings:
                x = h(a + x + b)
            proof = "".join(a + b for a, b in siblings)
            out.append((r[0], leaf_of(r), subroot, root, h(proof), x, x == root, proof))
    return sorted(out, key=repr)


def rows_of(sizes, rnd):
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            text = rnd.choice([None, "", "lower only", "Some Text ÄÖ", "x" * 3000 + "Y", "đ"])
            rows.append((rnd.randrange(10**6), text, rnd.choice([None, "en"]), s, rnd.choice([None, 5]), 1, "g", "d", "p", 2))
    rows += [(None, "A", None, "hot", None, 1, "g", "d", "p", 2), (None, "B", None, "hot", None, 1, "g", "d", "p", 2), (7, "Same", "en", "hot", 4, 1, "g", "d", "p", 2), (7, "Same", "en", "hot", 4, 1, "g", "d", "p", 2), (7, "Other", "en", "hot", 4, 1, "g", "d", "p", 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("arity, levels, queue", [(3, 2, 2), (2, 1, 1 << 16), (16, 3, 1 << 16)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, arity, levels, queue):
    """A hot source over many blocks, lone leaves, full and ragged runs, null sources, null and repeated ids, clashing names."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "QUEUE", queue)
    rows = rows_of({"hot": 90, None: 10, "": 1, "one": 1, "nine": 9, "ten": 10, "é": 3, "z": 28, **{f"s{k}": 2 for k in range(9)}}, random.Random(arity))
    out = manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(5), arity, with_proofs=True)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == plain(rows, arity)
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
    row = (5, None, None, None, None, 1, "g", "d", "p", 2)
    got = [tuple(r) for r in manifest.manifest(spark.createDataFrame([row], DOCS)).collect()]
    leaf = h("1:5----")
    assert got == [(5, leaf, leaf, leaf, h(""), leaf, True)]


def test_queue_spills_and_keeps_order():
    rnd, now, queue, plain_heap, out, want = random.Random(1), 0, manifest.LabelQueue(3, 2), [], [], []
    for k in range(400):
        for _ in range(rnd.randrange(4)):
            label = now + 1 + rnd.randrange(30)
            queue.send(label, (label, k))
            heapq.heappush(plain_heap, (label, k))
        now += 1
        out += queue.take(now)
        while plain_heap and plain_heap[0][0] == now:
            want.append(heapq.heappop(plain_heap))
    assert out == want and len(queue.runs) <= 3
