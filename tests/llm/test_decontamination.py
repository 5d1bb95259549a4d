"""Benchmark decontamination against a plain search for every window."""

import random
import re
from hashlib import sha256

import pytest

from hearken.llm import decontamination

DOCS = "doc_id long, text string, n_words int, hit string, window string, item string, _row long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(docs, items, size):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        places = list(WORD.finditer(lower(t)))
        w = [m[0] for m in places]
        hit, found = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        spans = [(places[k].start(), k) for k in sorted(hit) if k - 1 not in hit]
        ends = [places[k].end() for k in sorted(hit) if k + 1 not in hit]
        out.append((d, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(found), [(a, b) for (a, _), b in zip(spans, ends, strict=True)]))
    return sorted(out, key=repr)


def rows_of(rnd):
    words = ["Ab", "ab", "é", "ÉT", "x1", "2", "日本", "zz", "q", "\x7fw"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "\n", "--", ", ", "\x00", "'"]) for _ in range(n))
    items = [(k, text(rnd.choice([3, 4, 5, 9]))) for k in range(30)] + [(None, text(6)), (None, text(5)), (3, text(7)), (40, None), (41, ""), (42, "?!"), (10, text(5)), (9, text(8))]
    docs = [(k, text(rnd.randrange(40)) + (rnd.choice(items)[1] or "") + text(5)) for k in range(60)]
    docs += [(None, None), (None, ""), (1, docs[1][1]), (2, "only ... punctuation ?"), (70, text(3000)), (71, "x" * 100_000 + " " + items[0][1].upper())]
    return docs, items


@pytest.mark.parametrize("pairs, piece", [(1 << 18, 1 << 22), (25, 1 << 22), (1 << 18, 7)])
def test_contamination_equals_a_plain_search(spark, monkeypatch, pairs, piece):
    """Short items, windows inside others, letters of all kinds, null and repeated ids; one automaton and several; texts in pieces."""
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    docs, items = rows_of(random.Random(3))
    frame = spark.createDataFrame([(*r, 1, "h", "w", "i", 2) for r in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, window string")
    out = decontamination.contamination(frame, bench, size=5)
    got = sorted(((*r[:7], [(s.start, s.end) for s in r.spans]) for r in out.collect()), key=repr)
    assert got == plain(docs, items, 5)
    assert 5 < sum(r[5] for r in got) < len(got)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench).collect()] == [(3, 0, 0, False)]
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
