"""Scores, gates, batches, stop rules and duplicates against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from hearken.operators import batches, dedupe, gates, groups, profiles, scoring


def score(spark, content, record_type="POST", source="SEARCH_POSTS", parent=None, status=None, anchors=("Thẻ Vàng",), related=("phí", "lãi"), negative=("inbox", "sale", "ref")):
    df = spark.createDataFrame([(content, record_type, source, parent, status)], "c string, t string, s string, p string, ps string")
    profile = scoring.normalized_profile(scoring.lit_profile(anchors, related, negative))
    return df.select(scoring.relevance("c", "t", "s", profile, "p", "ps").alias("r")).first()["r"]


def test_relevance_thresholds(spark):
    r = score(spark, "thẻ vàng thu phí và lãi cao quá " * 3, source="CRAWL_FEED")
    assert (r["status"], r["score"], r["reason"]) == ("ACCEPTED", 0.58, "anchor_hits=1, related_hits=2")
    r = score(spark, "thẻ vàng thu phí")  # too short holds it back
    assert r["status"] == "REJECTED" and r["quality_flags"] == ["too_short"] and r["score"] == round(0.22 + 0.06 + 0.03 - 0.08, 4)
    r = score(spark, "thẻ vàng phí lãi inbox sale " * 6, anchors=("thẻ vàng", "vàng phí"))
    assert r["breakdown"]["negative_penalty"] == 0.36 and r["status"] == "UNCERTAIN"
    r = score(spark, "ok", "COMMENT", parent="bài về thẻ vàng", status="ACCEPTED")
    assert r["status"] == "UNCERTAIN" and r["breakdown"]["parent_context_score"] == 0.3
    r = score(spark, None)
    assert r["status"] == "REJECTED" and r["score"] == 0.0 and r["reason"] == "weak_signal"
    assert score(spark, "inbox sale ref " * 9)["score"] == 0.0


def test_rule_judge_order(spark):
    rows = [("Inbox mình nhé", "POST"), ("Mình bị trừ tiền", "POST"), ("Có nên không?", "COMMENT"), ("Có nên không?", "POST"), ("Xe nào tốt hơn", "POST")]
    df = spark.createDataFrame(rows, "c string, t string")
    got = [r["j"]["decision"] for r in df.select(scoring.rule_judge("c", "t").alias("j")).collect()]
    assert got == ["REJECTED", "ACCEPTED", "UNCERTAIN", "UNCERTAIN", "ACCEPTED"]
    assert df.select(scoring.rule_judge(F.lit("x"), "t", F.lit("Before")).alias("j")).first()["j"]["reason_codes"] == ["visual_signal_present"]


def test_normalize_judge(spark):
    df = spark.createDataFrame([("accepted ", "2", "x", ["  a ", ""]), ("maybe", "0.7", "-1", None), (None, "nan", None, []), ("?", "0.5", "0.5", None)], "d string, r string, c string, k array<string>")
    got = [r["j"] for r in df.select(scoring.normalize_judge("d", "r", "c", F.col("k"), F.lit("s"), F.lit("i")).alias("j")).collect()]
    assert [(g["decision"], g["relevance_score"], g["confidence_score"], g["reason_codes"]) for g in got] == [
        ("ACCEPTED", 1.0, 0.0, ["a"]), ("ACCEPTED", 0.7, 0.0, ["decision_accepted"]), ("REJECTED", 0.0, 0.0, ["decision_rejected"]), ("UNCERTAIN", 0.5, 0.5, ["decision_uncertain"]),
    ]


def test_hard_filter(spark):
    rows = [("", "POST"), ("Like Comment\nShare", "POST"), ("xin giá", "COMMENT"), ("ib nhé bạn ơi", "COMMENT"), ("ib " + "dài " * 9, "COMMENT"), ("ok", "POST")]
    policy = F.struct(F.lit(8).alias("minimum_comment_text_length"), F.lit(True).alias("reject_transactional_only_comments"))
    df = spark.createDataFrame(rows, "c string, t string")
    got = [r[0] for r in df.select(gates.hard_filter("c", "t", policy, cleaned=F.regexp_replace("c", "\n", " "))).collect()]
    assert got == ["empty_content", "ui_noise_only", "comment_too_short", "transactional_only_comment", None, None]
    none = F.lit(None).cast("struct<minimum_comment_text_length:int,reject_transactional_only_comments:boolean>")
    assert df.select(gates.hard_filter("c", "t", none).alias("x")).filter("x is not null").count() == 1


def test_source_gates(spark):
    names = ["Vay tiền mở thẻ nhanh", "Tín dụng 0912345678", "Tài chính hỗ trợ", "Tài chính hỗ trợ review", "Cộng đồng khách hàng", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(gates.broker_group("n")).collect()] == [True, True, True, False, False, False]
    urls = [("https://x/TheVang/posts/1", "brand"), ("https://thevang.example/videos/1", "brand"), ("https://x/groups/thevang/posts/1", "brand"), ("https://x/thevang/posts/1", "question"), ("https://x/thevang", "brand"), (None, "brand")]
    df = spark.createDataFrame(urls, "u string, f string")
    assert [r[0] for r in df.select(gates.official_brand_page("u", F.array(F.lit("Thevang"), F.lit("abc")), "f")).collect()] == [True, True, False, False, False, False]


def test_audience(spark):
    rows = [(None, None, None), ("end_user", "low", 0.9), ("end_user", "high", 0.45), ("end_user", "high", 0.44), ("unknown", "high", 0.59), ("brand_official", "high", 0.9), ("community_admin", "medium", 0.9), ("seller_affiliate", "high", 0.1)]
    df = spark.createDataFrame(rows, "r string, v string, c double")
    got = lambda a: [x[0] for x in df.select(gates.audience_reason("r", "v", "c", a)).collect()]
    assert got("end_user_only") == ["missing_label", "low_relevance", None, "low_confidence", "unknown", "brand_official", "community_admin", "seller_affiliate"]
    assert got("include_seller") == ["missing_label", "low_relevance", None, None, "low_confidence", "brand_official", "community_admin", None]
    assert got(" Include_Brand ") == ["missing_label", "low_relevance", None, None, None, None, "community_admin", None]
    with pytest.raises(ValueError):
        gates.audience_reason("r", "v", "c", "everyone")


def walk(path, size, max_weak=2, max_zero=2, max_scanned=60, min_accepted=3):
    """The stop rules, batch by batch."""
    out, weak, zero, ta, ts = [], 0, 0, 0, 0
    for b in range(0, len(path), size):
        x = path[b : b + size]
        acc = sum(d == "ACCEPTED" for d, _, _ in x)
        high = sum(d == "ACCEPTED" and c >= 0.75 and r >= c * 0.6 for d, r, c in x)
        unc = sum(d == "UNCERTAIN" for d, _, _ in x)
        decision = "continue" if acc / len(x) >= 0.15 or high / len(x) >= 0.05 else "reformulate" if unc / len(x) >= 0.25 else "weak"
        ta, ts = ta + acc, ts + len(x)
        weak = weak + 1 if decision == "weak" else 0
        zero = zero + 1 if acc == 0 else 0
        verdict, why = ("reformulate", None) if decision == "reformulate" and ta == 0 else ("continue", None)
        if weak >= max_weak:
            verdict, why = "stop", "weak_batches_exceeded"
        if ta == 0 and zero >= max_zero:
            verdict, why = "stop", "zero_accepted_batches_exceeded"
        if ts >= max_scanned and ta < min_accepted:
            verdict, why = "stop", "min_accepts_not_reached"
        out.append((len(out) + 1, len(x), acc, decision, verdict, why, ta, ts))
        if verdict != "continue":
            break
    return out


def paths(seed=5):
    rnd, rows, model = random.Random(seed), [], {}
    for p in range(60):
        n = rnd.choice([1, 19, 20, 21, 40, 60, 61, 100])
        mix = rnd.choice([(0.0, 0.1), (0.02, 0.3), (0.2, 0.2), (0.05, 0.05)])
        own = []
        for _ in range(n):
            u = rnd.random()
            own.append(("ACCEPTED" if u < mix[0] else "UNCERTAIN" if u < sum(mix) else "REJECTED", round(rnd.random(), 2), rnd.choice([0.5, 0.75, 0.9])))
        model[f"p{p}"] = own
        rows += [(f"p{p}", i + 1, *x) for i, x in enumerate(own)]
    return rows, model


def test_stop_rules_equal_the_walk(spark):
    rows, model = paths()
    df = spark.createDataFrame(rows, "path_id string, ordinal long, decision string, relevance_score double, confidence_score double").repartition(4)
    h = batches.batch_health_v2(batches.assign_batches(df, ["path_id"], ["ordinal"]), ["path_id", "batch_index"])
    got = {}
    for r in batches.apply_stop_rules(h, ["path_id"]).orderBy("path_id", "batch_index").collect():
        got.setdefault(r.path_id, []).append((r.batch_index, r.batch_size, r.accepted_count, r.decision, r.batch_decision, r.stop_reason, r.total_accepted, r.total_scanned))
    assert got == {p: walk(x, 20) for p, x in model.items()}
    s = {r.path_id: r for r in batches.path_summaries(batches.apply_stop_rules(h, ["path_id"]), ["path_id"]).collect()}
    for p, x in model.items():
        last = walk(x, 20)[-1]
        assert s[p].should_reformulate == (last[6] == 0 and last[4] != "continue")


def test_query_attempts(spark):
    rows = [("a", 0, "q", 5, 0, True), ("a", 1, "q2", 4, 0, True), ("a", 2, "q3", 3, 0, True), ("b", 0, "q", 2, 1, True), ("b", 1, "z", 2, 0, True), ("c", 0, "q", 2, 0, False), ("c", 1, "q2", 2, 0, True)]
    df = spark.createDataFrame(rows, "step string, ordinal int, query string, collected_count int, accepted_count int, should_reformulate boolean")
    got = [(r.step, r.ordinal, r.used_reformulation) for r in batches.cut_query_attempts(df, ["step"], 9).orderBy("step", "ordinal").collect()]
    assert got == [("a", 0, False), ("a", 1, True), ("b", 0, False), ("c", 0, False)]
    q = df.withColumn("reformulated_queries", F.when(F.col("ordinal") == 0, F.array(F.lit("Q  "), F.lit("New one"))).otherwise(F.array(F.lit("new  ONE"))))
    out = [r["query"] for r in batches.queue_rewrites(q.filter("step = 'a'"), ["step"]).orderBy("ordinal").collect()]
    assert out == ["q", "q2", "q3", "New one"]


def test_duplicates(spark):
    rows = [(1, "r", "b1", "u", "a"), (2, "r", "b1", "u", "b"), (3, "r", "b2", "u", "c"), (4, "r", "b1", None, "n"), (5, "r", "b1", "", "n"), (6, "r", "b2", None, "n"), (7, "s", "b1", "u", "a")]
    df = spark.createDataFrame(rows, "ordinal int, run_id string, batch string, source_url string, post_id string")
    m = {r.ordinal: (r.dup_in_batch, r.dup_in_run) for r in dedupe.mark_duplicates(df, "run_id", ["batch"], ["ordinal"]).collect()}
    assert m == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (True, False), 6: (False, False), 7: (False, False)}
    assert sorted(r.ordinal for r in dedupe.keep_first(df, "run_id", ["batch"], ["ordinal"]).collect()) == [1, 4, 6, 7]


def test_renamed_ids_and_parents(spark):
    cols = "post_id string, run_id string, ordinal int, source_url string, parent_post_id string, parent_post_url string"
    stored = spark.createDataFrame([("p", "run-old", 0, "u0", None, None), ("p--new", "run-new", 0, None, None, None)], cols)
    inc = spark.createDataFrame([("p", "run-new", 1, "u1", None, None), ("p", "run-new", 2, None, None, None), ("c", "run-new", 3, None, "p", "u1"), ("d", "run-new", 4, None, "p", None), ("e", "run-new", 5, None, "zz", None)], cols)
    got = {r.ordinal: (r.post_id, r.parent_post_id) for r in dedupe.rename_collisions(inc, stored, ["ordinal"]).collect()}
    assert got[1][0] == "p--new-1" and got[2][0] == "p--new-2" and got[3] == ("c", "p--new-1") and got[4] == ("d", "p--new-2") and got[5] == ("e", "zz")


def test_skewed_run_goes_through(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).cast("string").alias("run_id"), F.lit("b").alias("batch"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("post_id"), (F.col("id") % 5000).cast("string").alias("source_url"))
    assert dedupe.dedupe_counters(dedupe.mark_duplicates(df, "run_id", ["batch"], ["ordinal"]), ["run_id"]).agg(F.sum(F.expr("inserted + duplicate_in_batch + duplicate_in_run"))).first()[0] == 20000


def test_groups_in_order(spark):
    g = "array<struct<group_id:string,privacy:string,status:string,can_access:boolean>>"
    cp = spark.createDataFrame([("r", 1, ["g2"], [("g1", "PUBLIC", None, True), ("g2", "PRIVATE", "approved", False), ("", None, "approved", True)], None), ("r", 2, None, [("g3", "PRIVATE", "pending", False)], ["g9", "g1"])], f"run_id string, step_order int, accepted_group_ids array<string>, discovered_groups {g}, approved_group_ids array<string>")
    assert [r.group_id for r in groups.resolve_groups(cp).orderBy("ordinal").collect()] == ["g2", "g1", "g9"]
    more = cp.withColumns({"groups": F.lit(None).cast(g), "requested_group_ids": F.lit(None).cast("array<string>")})
    assert [r.group_id for r in groups.private_groups(more).orderBy("ordinal").collect()] == ["g2", "g3"]
    assert [r.group_id for r in groups.requested_groups(more).orderBy("ordinal").collect()] == ["g3"]


def context(spark, topic="the vang", **kw):
    keywords = {k: kw.get(k, []) for k in ("brand", "pain_points", "sentiment", "behavior", "comparison")}
    return profiles.build_profile(spark.createDataFrame([(topic, keywords)], "topic string, keywords map<string,array<string>>"))


def spec(objective="", signals=()):
    return F.struct(F.lit(objective).alias("research_objective"), F.array(*map(F.lit, signals)).cast("array<string>").alias("target_signal_types"), F.array().cast("array<string>").alias("must_have_signals"))


def test_profile(spark):
    p = context(spark, "review thẻ vàng có ảnh", brand=["VPBank", "thẻ vàng", "Thẻ Vàng"], pain_points=["phí cao", "bị trừ"], comparison=["vàng vs bạc"])
    r = p.first()["profile"]
    assert r["anchors"] == ["VPBank", "thẻ vàng", "review thẻ vàng có ảnh"] and r["related_terms"] == ["phí cao", "bị trừ", "vàng vs bạc"]
    assert r["negative_terms"] == sorted(profiles.T.PROMO_TERMS) and r["source_hints"] == ["VPBank", "thẻ vàng", "phí cao", "bị trừ"]
    assert [f["intent"] for f in r["query_families"]] == ["brand", "pain_point", "pain_point", "question", "question", "comparison", "complaint", "complaint"]
    assert r["query_families"][0]["query"] == "review thẻ vàng có ảnh" and r["query_families"][6]["query"].startswith("loi ")


def test_suggested_queries(spark):
    p = context(spark, "thẻ vàng", brand=["thẻ vàng"], pain_points=["phí cao"], comparison=["vàng vs bạc"])
    one = lambda c: p.select(c).first()[0]
    q = lambda text, s=spec(), n=3: one(profiles.suggest_queries(F.lit(text), F.col("profile"), s, n))  # noqa: E731,B008
    assert q("thẻ vàng") == ["thẻ vàng", "thẻ vàng phí cao", "thẻ vàng vàng vs bạc"]
    assert q("vàng vs", n=2) == ["vàng vs bạc", "vàng vs"]
    assert q("thẻ vàng", spec("is it a scam"))[:2] == ["thẻ vàng", "thẻ vàng bi lua"]
    assert one(profiles.build_reformulations(F.lit("thẻ vàng"), F.col("profile"), spec(), F.lit("cost_gap"))) == ["thẻ vàng phi cao", "thẻ vàng lai suat cao"]
    assert one(profiles.infer_query_family(F.lit("xyz có tốt?"), F.col("profile"))) == "question"
    assert one(profiles.infer_query_family(F.lit("phí cao quá"), F.col("profile"))) == "pain_point"
    assert one(profiles.infer_query_family(F.lit("xyz"), F.col("profile"))) == "generic"


def test_search_targets(spark):
    df = spark.createDataFrame([("brand: VPBank (x), thẻ tín dụng | a",), ("public-groups; from step-1",), ("",), (None,), ("keywords: một hai ba bốn năm sáu bảy",)], "t string")
    got = [r[0] for r in df.select(profiles.pick_search_query("t", F.lit("topic"))).collect()]
    assert got == ["thẻ tín dụng", "public-groups", "topic", "topic", "một hai ba bốn năm"]
    df = spark.createDataFrame([("keyword: thẻ vàng in groups from step-2",), ("SEARCH: abc in x",), ("abc in groups",), ("",)], "t string")
    assert [r[0] for r in df.select(profiles.resolve_search_query("t")).collect()] == ["thẻ vàng", "abc", "abc", "research"]


def test_reason_clusters(spark):
    r = spark.createDataFrame([("a", "fee_x", 1), ("a", "promoted", 2), ("b", "other", 1)], "path_id string, reason string, ordinal long")
    paths_ = spark.createDataFrame([("a", "q", ""), ("b", "q", "trust me"), ("c", "q", "trust"), ("d", "trust", "trust"), ("e", "q", "")], "path_id string, query string, signals string")
    got = {x.path_id: x.reason_cluster for x in profiles.cluster_reject_reasons(r, paths_).collect()}
    assert got == {"a": "cost_gap", "b": "generic_weak", "c": "trust_gap", "d": "generic_weak", "e": "generic_weak"}


def test_contract_hash(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "đ"}',), (None,)], "j string")
    import hashlib

    assert df.select(profiles.contract_hash("j")).first()[0] == hashlib.sha256('{"a": "đ", "b": 1}'.encode()).hexdigest()[:10]


def test_validity_specs(spark):
    own = '{"target_signal_types": ["Pain", "pain ", "fee"], "valid_examples": ["a","b","c","d","e","f"], "batch_policy": {"min_accept_ratio": 7, "max_consecutive_weak_batches": 0}, "comment_policy": {"minimum_comment_text_length": -3}}'
    base = '{"research_objective": "base", "target_signal_types": ["x"], "comment_policy": {"reject_transactional_only_comments": false}, "batch_policy": {"min_accept_ratio": 0.15, "min_high_conf_accept_ratio": -1, "max_consecutive_weak_batches": 2, "uncertain_reformulation_floor": 0.25}}'
    df = spark.createDataFrame([("Đồng hồ", own, base), ("t", "{}", base)], "topic string, s string, f string")
    df = df.select("topic", F.from_json("s", profiles.SPEC_JSON).alias("spec"), F.from_json("f", profiles.SPEC_JSON).alias("fallback"))
    a, b = [r.spec for r in profiles.normalize_validity_spec(df).collect()]
    assert a.target_signal_types == ["Pain", "fee"] and len(a.valid_examples) == 5 and a.spec_id.startswith("spec-dong-ho-") and a.research_objective == "base"
    assert tuple(a.batch_policy) == (1.0, 0.0, 1, 0.25) and tuple(a.comment_policy) == (True, False, 0) and b.target_signal_types == ["x"] and tuple(b.comment_policy) == (True, False, 8)
    assert a.spec_version != b.spec_version


def test_spec_version_is_the_digest_of_the_contract(spark):
    import hashlib
    import json

    base = '{"research_objective": " base ", "target_signal_types": ["x", "X"], "comment_policy": {}, "batch_policy": {"min_accept_ratio": 0.1}}'
    df = spark.createDataFrame([("Đồng \"hồ\"", {"brand": ["a", "é"]}, base, "buy")], "topic string, k map<string,array<string>>, f string, i string")
    df = df.select("topic", "k", "i", F.from_json(F.lit('{"must_have_signals": []}'), profiles.SPEC_JSON).alias("spec"), F.from_json("f", profiles.SPEC_JSON).alias("fallback"))
    got = profiles.normalize_validity_spec(df, keywords=F.col("k"), plan_intent=F.col("i")).first().spec.spec_version
    want = {"topic": 'Đồng "hồ"', "clarification_history": [], "keywords": {"brand": ["a", "é"]}, "retrieval_profile": {}, "plan_intent": "buy", "research_objective": " base ", "target_signal_types": ["x", "X"], "must_have_signals": [], "hard_reject_signals": None}
    assert got == "phase8-v1-" + hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:10]
