"""Large term lists, numbering of large groups, duplicates and nesting against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from hearken.operators import batches, dedupe, groups, numbering, scoring, termscan, threads


@pytest.mark.parametrize("most, hot", [(1 << 24, 50_000), (0, 5)])
def test_terms_of_large_lists(spark, monkeypatch, most, hot):
    """Terms within terms, repeated, empty and null ones; texts without a profile; broadcast and dealt."""
    monkeypatch.setattr(termscan, "HOT", hot)
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    lists = {k: [[word(rnd.randrange(1, 5)) for _ in range(60)] + ["", None, "ab", "ab"] for _ in range(2)] + [None] for k in ("x", "y")}
    rows = [(i, rnd.choice("xxxxxyz"), rnd.choice([None, "", word(60), "ab" * 400])) for i in range(200)] + [(900, None, "ab")]
    profiles = spark.createDataFrame([(k, *v) for k, v in lists.items()], "run string, anchors array<string>, related_terms array<string>, negative_terms array<string>")
    out = termscan.scan_terms(spark.createDataFrame(rows, "n int, run string, text string").repartition(3), profiles, "run", "text", most_bytes=most)
    got = {r.n: (r.run, r.text, tuple(r.hits)) for r in out.collect()}
    count = lambda terms, t: sum(1 for x in terms or [] if x and x in (t or ""))
    assert got == {n: (k, t, tuple(count(terms, t) for terms in lists.get(k, [[], [], []]))) for n, k, t in rows}
    assert termscan.scan_terms(spark.createDataFrame(rows, "n int, run string, text string"), profiles.limit(0), "run", "text", most_bytes=most).filter("hits.anchors > 0").count() == 0


def test_scores_from_scanned_terms(spark):
    """A score is the same, whichever way the terms were counted."""
    profile = scoring.normalized_profile(scoring.lit_profile(["Lãi suất", "app"], ["phí"], ["inbox"]))
    df = spark.createDataFrame([("r", "Lãi suất của app cao, phí ẩn thì nhiều lắm"), ("r", "inbox mình nhé"), ("r", None)], "run string, c string").withColumn("profile", profile)
    key = df.withColumn("key", F.when(F.col("c").isNotNull(), scoring.normalize_text("c")))
    profiles = df.select("run", "profile.*").distinct()
    scanned = termscan.scan_terms(key, profiles, "run", "key")
    clean = scoring.clean_payload("c")
    one = [r.s for r in key.select(scoring.relevance("c", F.lit("POST"), F.lit("CRAWL_FEED"), F.col("profile"), cleaned=clean).alias("s")).collect()]
    two = [r.s for r in scanned.select(scoring.relevance("c", F.lit("POST"), F.lit("CRAWL_FEED"), F.col("profile"), cleaned=clean, found=F.col("hits")).alias("s")).collect()]
    assert one == two and one[0].score > 0


def test_numbering(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 20 + ["a", None]), rnd.choice([None, *range(2000)]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(5)
    got = numbering.numbered(df, ["g"], ["o"]).collect()
    assert sorted(r.id for r in got) == list(range(1500))
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(1, len(rs) + 1))
        keys = [(r.o is not None, r.o or 0) for r in rs]
        assert keys == sorted(keys)
    assert numbering.numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_batches_of_a_large_path_have_no_window_over_texts(spark):
    df = spark.createDataFrame([("p", i, f"text {i}") for i in range(50)], "path string, n int, content string")
    out = batches.assign_batches(df, ["path"], ["n"], 20)
    assert {r.n: r.batch_index for r in out.collect()} == {i: i // 20 + 1 for i in range(50)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_last_previews_of_paths(spark):
    df = spark.createDataFrame([(p, i, f"{p}{i}", f"text {i}") for p, n in (("a", 7), ("b", 2), (None, 4)) for i in range(n)], "path string, n int, post_id string, content string")
    got = sorted((r.path or "", r.position, r.post_id) for r in groups.last_previews(df, ["path"], ["n"]).collect())
    assert got == [("", 2, "None1"), ("", 3, "None2"), ("", 4, "None3"), ("a", 5, "a4"), ("a", 6, "a5"), ("a", 7, "a6"), ("b", 1, "b0"), ("b", 2, "b1")]


@pytest.mark.parametrize("ties", [False, True])
def test_duplicates_of_a_hot_address(spark, ties):
    """Against a walk in order: first of a key in its batch, then first of an address in its run."""
    rnd = random.Random(ties)
    rows = [(rnd.choice(["r", "s"]), rnd.choice("abc"), rnd.randrange(40) if ties else i, f"p{rnd.randrange(150)}", rnd.choice(["hot", "hot", "hot", f"u{rnd.randrange(20)}", "", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, path string, n int, post_id string, source_url string").repartition(4)
    got = dedupe.mark_duplicates(df, "run_id", ["path"], ["n"]).collect()
    counts = {}
    for r in got:
        c = counts.setdefault((r.run_id, r.path), [0, 0, 0])
        c[1 if r.dup_in_batch else 2 if r.dup_in_run else 0] += 1
    seen_batch, seen_run, want = set(), {}, {}
    firsts = []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        key = r[4] or r[3]
        c = want.setdefault((r[0], r[1]), [0, 0, 0])
        if (r[0], r[1], key) in seen_batch:
            c[1] += 1
            continue
        seen_batch.add((r[0], r[1], key))
        firsts.append(r)
    for r in firsts:
        if r[4] and (r[0], r[4]) in seen_run:
            want[r[0], r[1]][2] += 1
        else:
            want[r[0], r[1]][0] += 1
            seen_run[r[0], r[4]] = r
    assert counts == want
    kept = dedupe.keep_first(df, "run_id", ["path"], ["n"])
    assert kept.columns == df.columns and kept.count() == sum(c[0] for c in want.values())


def test_nesting_of_a_long_thread(spark):
    """Against a walk that looks back from each comment for the ones still open."""
    rnd = random.Random(4)
    indents = [rnd.choice([0.0, 5.0, 9.0, 18.0, 20.0, 27.0, 40.0, 60.0, None, -5.0]) for _ in range(700)]
    got = threads.nest_by_indent(spark.createDataFrame([("p", i, x) for i, x in enumerate(indents)] + [("q", 1, 30.0), ("q", 0, 10.0)], "post string, ordinal int, indent double"))
    base = indents[0] or 0.0
    at = [max(0.0, (x or 0.0) - base) for x in indents]
    parent, begun, closed = {}, 0, set()
    for i, x in enumerate(at):
        closed |= {j for j in range(begun, i) if at[j] + 8 >= x}
        still = [j for j in range(begun, i) if j not in closed]
        if still and x >= at[still[-1]] + 18:
            parent[i] = still[-1]
        else:
            parent[i], begun = None, i
    rows = got.collect()
    assert {r.ordinal: r.parent for r in rows if r.post == "p"} == parent
    assert {r.ordinal: r.parent for r in rows if r.post == "q"} == {0: None, 1: 0}
