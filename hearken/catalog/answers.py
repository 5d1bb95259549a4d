"""Queries of closeouts and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, closeout
from ..operators.closeout import ATTEMPT, BATCH, CHECKPOINT
from ..sources.tables import lenient_json
from ..views import judged, table, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of runs made from orders: checkpoints hold up to two attempts, or batches only."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    s = lambda x: x.cast("string")
    attempt = lambda j: F.struct(
        F.concat(F.lit("q"), s(k % 17), F.lit(f"-{j}")).alias("query"), ((k + j) % 90).alias("collected_count"), F.when(F.col("o_custkey") % 200 % 3 == 0, 0).otherwise(k % 4).cast("long").alias("accepted_count"),
        F.when(F.lit(j == 1), "weak_batches_exceeded").alias("stop_reason"), F.when((k + j) % 3 == 0, "generic_weak").when((k + j) % 3 == 1, "promo_noise").otherwise("cost_gap").alias("reason_cluster"),
        F.array().cast("array<string>").alias("reformulated_queries"), F.lit(j == 1).alias("used_reformulation"),
    ).cast(ATTEMPT)
    none = F.array().cast(f"array<{ATTEMPT}>")
    tried = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(attempt(0))).otherwise(F.array(attempt(0), attempt(1)))
    batch = F.struct(
        F.lit(1).alias("batch_index"), (k % 30).alias("batch_size"), F.when(F.col("o_custkey") % 200 % 3 == 0, 0).otherwise(k % 2).cast("long").alias("accepted_count"), F.lit("continue").alias("batch_decision"), F.lit(None).cast("string").alias("decision"),
        F.when(k % 2 == 0, "target_weak").alias("reason_cluster"), F.when(k % 5 == 0, "min_accepts_not_reached").alias("stop_reason"),
    ).cast(BATCH)
    made = F.struct(F.when(k % 4 == 0, k % 60).alias("collected_count"), tried.alias("query_attempts"), F.array(batch).alias("batch_summaries"))
    raw = F.when(k % 97 == 0, "{broken").otherwise(F.to_json(made))
    action = F.element_at(F.array(*map(F.lit, ("SEARCH_POSTS", "SEARCH_IN_GROUP", "CRAWL_FEED", "CRAWL_COMMENTS", "JOIN_GROUP"))), (k % 5 + 1).cast("int"))
    out = o.select(
        F.concat(F.lit("r"), s(F.col("o_custkey") % 200)).alias("run_id"), F.concat(F.lit("s"), s(k)).alias("step_run_id"), F.concat(F.lit("p"), s(k)).alias("step_id"), (k % 1000).cast("int").alias("step_order"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), action.alias("action_type"), F.when(k % 11 == 0, "PENDING").when(k % 13 == 0, "FAILED").otherwise("DONE").alias("status"), (k % 40).cast("int").alias("actual_count"),
        F.concat(F.lit("t"), s(k % 7)).alias("target"), F.lit("RUNNING").alias("run_status"), F.when(k % 13 == 0, "boom").alias("error_message"), F.lit("").alias("a"), raw.alias("b"),
    )
    return out.withColumn("checkpoint", lenient_json(CHECKPOINT, "a", "b")).drop("a", "b")


STEPS = """st AS (SELECT 'r' || (o_custkey % 200) AS run_id, 's' || o_orderkey AS step_run_id, 'p' || o_orderkey AS step_id, o_orderkey AS k, o_orderkey % 1000 AS step_order, strftime(o_orderdate, '%Y-%m-%d') AS started_at, o_custkey % 200 % 3 = 0 AS dry,
        ['SEARCH_POSTS', 'SEARCH_IN_GROUP', 'CRAWL_FEED', 'CRAWL_COMMENTS', 'JOIN_GROUP'][o_orderkey % 5 + 1] AS action_type, CASE WHEN o_orderkey % 11 = 0 THEN 'PENDING' WHEN o_orderkey % 13 = 0 THEN 'FAILED' ELSE 'DONE' END AS status,
        o_orderkey % 40 AS actual_count, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey % 3 END AS n, o_orderkey % 97 = 0 AS broken FROM orders),
    m AS (SELECT *, CASE WHEN n > 0 THEN n * CASE WHEN dry THEN 0 ELSE k % 4 END WHEN broken THEN 0 ELSE CASE WHEN dry THEN 0 ELSE k % 2 END END AS accepted,
        CASE WHEN n = 1 THEN k % 90 WHEN n = 2 THEN k % 90 + (k + 1) % 90 ELSE coalesce(nullif(CASE WHEN k % 4 = 0 AND NOT broken THEN k % 60 END, 0), nullif(actual_count, 0), CASE WHEN broken THEN 0 ELSE k % 30 END) END AS scanned,
        list_filter([CASE WHEN n >= 1 THEN ['generic_weak', 'promo_noise', 'cost_gap'][k % 3 + 1] END, CASE WHEN n = 2 THEN ['generic_weak', 'promo_noise', 'cost_gap'][(k + 1) % 3 + 1] END, CASE WHEN k % 2 = 0 AND NOT broken THEN 'target_weak' END], lambda x: x IS NOT NULL) AS clusters,
        list_filter([CASE WHEN n = 2 THEN 'weak_batches_exceeded' END, CASE WHEN k % 5 = 0 AND NOT broken THEN 'min_accepts_not_reached' END], lambda x: x IS NOT NULL) AS stops FROM st)"""


@query(f"WITH {STEPS} SELECT step_run_id, accepted::BIGINT AS accepted, scanned::BIGINT AS scanned, array_to_string(clusters, ',') AS clusters, array_to_string(stops, ',') AS stops FROM m")
def ag_search_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = closeout.search_step_metrics(steps(spark, d))
    return m.select("step_run_id", "accepted", "scanned", F.array_join("reason_clusters", ",").alias("clusters"), F.array_join("stop_reasons", ",").alias("stops"))


@query(f"WITH {STEPS}" + """, dn AS (SELECT * FROM m WHERE status = 'DONE' AND action_type IN ('SEARCH_POSTS', 'SEARCH_IN_GROUP', 'CRAWL_FEED') AND scanned > 0),
    t AS (SELECT run_id, count(*) AS completed_search_steps, count(*) FILTER (accepted = 0) AS zero_accept_search_steps, sum(accepted) AS acc, sum(scanned)::BIGINT AS scanned_records, max(len(stops) > 0) AS weak FROM dn GROUP BY 1),
    c AS (SELECT run_id, step_order, started_at, step_run_id, unnest(clusters) AS v, generate_subscripts(clusters, 1) AS i FROM dn),
    cn AS (SELECT run_id, v, count(*) AS n, min({'a': step_order, 'b': started_at, 'c': step_run_id, 'd': i}) AS pos FROM c GROUP BY ALL), cd AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, pos, v) AS rn FROM cn)
    SELECT t.run_id, completed_search_steps, zero_accept_search_steps, scanned_records, cd.v AS dominant_reason_cluster, (SELECT string_agg(step_id, ',' ORDER BY step_order, step_id) FROM m WHERE m.run_id = t.run_id AND status = 'PENDING') AS skipped
    FROM t LEFT JOIN cd ON cd.run_id = t.run_id AND rn = 1 WHERE acc = 0 AND completed_search_steps >= 2 AND scanned_records >= 120 AND (cd.v IN ('generic_weak', 'target_weak', 'promo_noise') OR weak)
        AND EXISTS (SELECT 1 FROM m WHERE m.run_id = t.run_id AND status = 'PENDING')""")
def ag_exhaustion(spark: SparkSession, d: str) -> DataFrame:
    e = closeout.exhaustion(steps(spark, d))
    return e.select("run_id", "completed_search_steps", "zero_accept_search_steps", "scanned_records", "dominant_reason_cluster", F.array_join("skipped_step_ids", ",").alias("skipped"))


@query(SQL["ag_exhaustion"].replace("WITH ", "WITH fired AS (WITH ", 1) + ") " + f", {STEPS} SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM fired) AND status = 'PENDING' THEN 'SKIPPED' ELSE status END AS status, count(*) AS steps FROM m GROUP BY ALL")
def ag_skipped_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps by status after the pending ones of exhausted runs were skipped."""
    s = steps(spark, d)
    return closeout.skip_steps(s, closeout.exhaustion(s)).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("steps"))


@query(f"WITH {STEPS}" + """, dn AS (SELECT * FROM m WHERE status = 'DONE' AND action_type IN ('SEARCH_POSTS', 'SEARCH_IN_GROUP', 'CRAWL_FEED')),
    a AS (SELECT run_id, started_at, step_run_id, k, n, actual_count, dry, broken, unnest(CASE WHEN n = 2 THEN [0, 1] ELSE [0] END) AS j FROM dn)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY started_at, step_run_id, j) AS ordinal, CASE WHEN n = 0 THEN 't' || (k % 7) ELSE 'q' || (k % 17) || '-' || j END AS query,
        CASE WHEN n > 0 THEN (k + j) % 90 ELSE coalesce(nullif(CASE WHEN k % 4 = 0 AND NOT broken THEN k % 60 END, 0), actual_count) END::BIGINT AS collected_count, n > 0 AND j = 1 AS used_reformulation FROM a""")
def ag_attempted_queries(spark: SparkSession, d: str) -> DataFrame:
    return closeout.attempted_queries(steps(spark, d)).select("run_id", "ordinal", "query", "collected_count", "used_reformulation")


@query(f"WITH {STEPS}, a AS (SELECT run_id, step_run_id, k, n, dry, j FROM (SELECT *, unnest([0, 1]) AS j FROM m WHERE n = 2)), w AS (SELECT *, k % 4 AS acc FROM a)" + """
    SELECT step_run_id, j AS ordinal FROM w WHERE j = 0 OR (k % 90 < 60 AND (CASE WHEN dry THEN 0 ELSE acc END) = 0)""")
def wn_query_cutoff(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).select("step_run_id", F.posexplode("checkpoint.query_attempts").alias("ordinal", "a"), F.size("checkpoint.query_attempts").alias("n")).filter("n = 2")
    a = s.select("step_run_id", "ordinal", "a.query", "a.collected_count", "a.accepted_count", (F.col("a.accepted_count") == 0).alias("should_reformulate"))
    from ..operators.batches import cut_query_attempts

    return cut_query_attempts(a, ["step_run_id"], 60).select("step_run_id", "ordinal")


@query(with_views("candidates", "judged") + """, x AS (SELECT run_id, ordinal, unnest(judge_reason_codes) AS reason_code, generate_subscripts(judge_reason_codes, 1) AS i FROM judged),
    n AS (SELECT run_id, reason_code, count(*) AS count, min({'o': ordinal, 'i': i}) AS pos FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY count DESC, pos) AS rank FROM n) SELECT run_id, reason_code, count, rank FROM r WHERE rank <= 5""")
def ag_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return closeout.reject_reasons(judged(spark, d)).select("run_id", "reason_code", "count", "rank")


@query(with_views("candidates", "judged") + """, r AS (SELECT *, coalesce(nullif(judge_relevance_score, 0), nullif(pre_ai_score, 0), 0) AS score FROM judged WHERE coalesce(judge_decision, pre_ai_status, 'UNKNOWN') <> 'ACCEPTED')
    SELECT run_id, rank, post_id, score, content FROM (SELECT run_id, post_id, score, substr(content, 1, 180) AS content, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ordinal) AS rank FROM r) WHERE rank <= 3""")
def wn_near_misses(spark: SparkSession, d: str) -> DataFrame:
    return closeout.near_misses(judged(spark, d)).select("run_id", "rank", "post_id", "score", "content")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("run_id").distinct().select(
        "run_id", F.lit("fees").alias("topic"), F.lit("NO_ANSWER_CONTENT").alias("outcome_type"), F.lit("DONE").alias("status"), F.lit(None).cast("string").alias("failure_class"), F.lit("NO_ANSWER_CONTENT").alias("answer_status"), F.lit("2024-01-01T00:00:00Z").alias("started_at")
    )


def _steps_of(spark: SparkSession, d: str) -> DataFrame:
    """The steps again, for the runs of the judged records."""
    run = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.regexp_extract("run_id", r"(\d+)", 1).cast("int") % 4 + 1))
    return steps(spark, d).withColumns({"run_id": run, "step_run_id": F.concat(F.lit("s"), (F.regexp_extract("step_run_id", r"(\d+)", 1).cast("int") % 4).cast("string"))})


@query(f"{with_views('candidates', 'judged')}, {STEPS}" + """, s4 AS (SELECT ['en', 'fr', 'de', 'es'][(substr(run_id, 2)::INT % 4) + 1] AS run_id, status, action_type, n, k, broken FROM m),
    e AS (SELECT run_id, count(*) AS total_records, count(*) FILTER (s = 'ACCEPTED') AS accepted_count, count(*) FILTER (s = 'REJECTED') AS rejected_count, count(*) FILTER (s = 'UNCERTAIN') AS uncertain_count FROM (SELECT *, coalesce(judge_decision, pre_ai_status, 'UNKNOWN') AS s FROM judged) GROUP BY 1),
    d AS (SELECT run_id, count(*) AS search_steps_completed FROM s4 WHERE status = 'DONE' AND action_type IN ('SEARCH_POSTS', 'SEARCH_IN_GROUP', 'CRAWL_FEED') GROUP BY 1)
    SELECT e.*, search_steps_completed, 12 AS queries, 3 AS misses, CASE WHEN run_id < 'es' THEN 'Accepted records did not converge into a final answer' ELSE 'Run completed without usable evidence' END AS title,
        CASE WHEN run_id < 'es' THEN 'The run found candidate evidence for ''fees'', but the accepted set still did not form a stable theme answer after labeling and synthesis.'
        ELSE 'No eligible evidence was found for ''fees'' after ' || search_steps_completed || ' search steps and ' || total_records || ' persisted records. Labeling and theme synthesis were skipped.' END AS summary FROM e JOIN d USING (run_id)""")
def ag_no_answer(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("run_id") < "es", "NO_ANSWER_CONTENT").otherwise("NO_ELIGIBLE_RECORDS")
    p = closeout.no_answer_payload(_runs(spark, d).withColumn("outcome_type", outcome), judged(spark, d), _steps_of(spark, d))
    return p.select("run_id", "total_records", "accepted_count", "rejected_count", "uncertain_count", "search_steps_completed", F.size("attempted_queries").alias("queries"), F.size("near_miss_records").alias("misses"), "title", "summary")


_ONE = {
    "by_status": "SELECT 'by_status' AS breakdown, run_id, 'POST' AS record_type, coalesce(pre_ai_status, 'NULL') AS a, NULL AS b, count(*) AS count FROM judged GROUP BY ALL",
    "by_step": "SELECT 'by_step', run_id, 'POST', coalesce(pre_ai_status, 'NULL'), step_run_id, count(*) FROM judged GROUP BY ALL",
    "by_query_family": "SELECT 'by_query_family', run_id, NULL, coalesce(pre_ai_status, 'NULL'), query_family, count(*) FROM judged GROUP BY ALL",
    "by_batch_decision": "SELECT 'by_batch_decision', run_id, NULL, coalesce(batch_decision, 'NULL'), NULL, count(*) FROM judged GROUP BY ALL",
    "by_label_status": "SELECT 'by_label_status', run_id, NULL, label_status, NULL, count(*) FROM judged GROUP BY ALL",
    "by_provider": "SELECT 'by_provider', run_id, NULL, coalesce(provider_used, 'NULL'), fallback_used::VARCHAR, count(*) FROM judged GROUP BY ALL",
    "by_judge": "SELECT 'by_judge', run_id, NULL, coalesce(judge_decision, pre_ai_status, 'NULL'), judge_used_image_understanding::VARCHAR, count(*) FROM judged GROUP BY ALL",
}


@query(with_views("candidates", "judged") + " " + " UNION ALL ".join(_ONE.values()))
def ag_run_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    b = audit.run_breakdowns(judged(spark, d))
    status = F.when(F.col("breakdown").isin("by_status", "by_step", "by_query_family"), F.col("pre_ai_status"))
    a = F.coalesce(status, "batch_decision", "label_status", "provider_used", "decision")
    return b.select("breakdown", "run_id", "record_type", a.alias("a"), F.coalesce("step_run_id", "query_family", "fallback_used", "used_image_understanding").alias("b"), "count")


@query(with_views("candidates", "judged") + " SELECT run_id, min(crawled_s) AS first_record, min(crawled_s) FILTER (coalesce(judge_decision, pre_ai_status) = 'ACCEPTED') AS first_accepted, max(crawled_s) AS last_record FROM judged GROUP BY 1")
def ag_record_timing(spark: SparkSession, d: str) -> DataFrame:
    t = audit.record_timing(judged(spark, d))
    return t.select("run_id", *[F.unix_timestamp(f"{c}_at").alias(c) for c in ("first_record", "first_accepted", "last_record")])


@query(with_views("candidates", "judged") + " SELECT run_id, step_run_id, count(*) FILTER (pre_ai_status = 'ACCEPTED') AS accepted_total, count(*) FILTER (pre_ai_status = 'UNCERTAIN') AS uncertain_total, count(*) FILTER (pre_ai_status = 'REJECTED') AS rejected_total FROM judged GROUP BY ALL")
def ag_status_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.status_totals(judged(spark, d), ("run_id", "step_run_id"))


@query(with_views("candidates", "judged") + """ SELECT run_id, post_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE coalesce(judge_decision, pre_ai_status, 'NULL') WHEN 'ACCEPTED' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 2 END,
    coalesce(pre_ai_score, -1) DESC, post_id) AS rank FROM judged) WHERE rank <= 25""")
def wn_top_records(spark: SparkSession, d: str) -> DataFrame:
    return audit.top_records(judged(spark, d)).select("run_id", "post_id", "rank")


@query(with_views("candidates", "judged") + """ SELECT source_type, query_family, count(*) AS records, count(*) FILTER (pre_ai_status = 'ACCEPTED') AS accepted, round(count(*) FILTER (pre_ai_status = 'ACCEPTED') / count(*), 4) AS accepted_share,
    round(count(*) FILTER (pre_ai_status = 'REJECTED') / count(*), 4) AS rejected_share FROM judged GROUP BY ROLLUP (source_type, query_family)""")
def ag_gating_yield(spark: SparkSession, d: str) -> DataFrame:
    return audit.gating_yield(judged(spark, d)).select("source_type", "query_family", "records", "accepted", "accepted_share", "rejected_share")


@query("SELECT 'plan' || (o_custkey % 50) AS plan_id, sum(o_orderkey % 300)::BIGINT AS estimated_total_duration_sec, count(*) FILTER (o_orderkey % 4 <> 0) AS read_steps, count(*) FILTER (o_orderkey % 4 = 0) AS write_steps FROM orders GROUP BY 1")
def ag_plan_estimate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    s = o.select(F.concat(F.lit("plan"), (F.col("o_custkey") % 50).cast("string")).alias("plan_id"), (F.col("o_orderkey") % 300).alias("estimated_duration_sec"), F.when(F.col("o_orderkey") % 4 == 0, "WRITE").otherwise("READ").alias("read_or_write"))
    return audit.plan_estimate(s)


@query("SELECT 'r' || (o_custkey % 200) AS run_id, 's' || o_orderkey AS step_run_id, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey % 1000, o_orderdate, 's' || o_orderkey) AS position FROM orders")
def wn_step_positions(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).withColumn("plan_id", F.lit("plan"))
    plan = s.select("plan_id", "step_id", "step_order").distinct()
    return audit.ordered_steps(s.drop("step_order"), plan).select("run_id", "step_run_id", "position")


@query("SELECT run_id, step_run_id AS latest_step_run_id FROM (SELECT 'r' || (o_custkey % 200) AS run_id, 's' || o_orderkey AS step_run_id, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate DESC, 's' || o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def wn_latest_step(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).withColumn("heartbeat_at", F.col("started_at"))
    return audit.latest_steps(s).select("run_id", "latest_step_run_id")


@query(f"{with_views('candidates', 'judged')}, {STEPS}" + """, s4 AS (SELECT ['en', 'fr', 'de', 'es'][(substr(run_id, 2)::INT % 4) + 1] AS run_id, status FROM m),
    p AS (SELECT run_id, count(*) FILTER (pre_ai_status = 'ACCEPTED') AS accepted_total, count(*) FILTER (judge_used_image_understanding) AS image_fallback_total, min(crawled_s) - 1704067200.0::DOUBLE AS time_to_first_record_sec FROM judged GROUP BY 1),
    s AS (SELECT run_id, count(*) FILTER (status = 'DONE') AS done_steps, count(*) FILTER (status = 'PENDING') AS pending_steps, count(*) FILTER (status = 'FAILED') AS failed_steps FROM s4 GROUP BY 1)
    SELECT p.*, done_steps, pending_steps, failed_steps, 'failed_steps,accepted_without_themes' || CASE WHEN image_fallback_total = 0 THEN ',no_image_understanding' ELSE '' END AS concerns FROM p JOIN s USING (run_id)""")
def ag_run_analysis(spark: SparkSession, d: str) -> DataFrame:
    a = audit.run_analysis(_runs(spark, d), judged(spark, d), _steps_of(spark, d))
    known = F.filter("concerns", lambda c: c != "group_search_without_yield")
    return a.select("run_id", "accepted_total", "image_fallback_total", "time_to_first_record_sec", "done_steps", "pending_steps", "failed_steps", F.array_join(known, ",").alias("concerns"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NO_ELIGIBLE_RECORDS' WHEN 1 THEN 'ANSWER_READY' WHEN 2 THEN 'LABELS_READY_NO_ANSWER' WHEN 3 THEN 'ANSWER_CLOSEOUT_FAILED' ELSE 'FAILED' END AS reason FROM orders""")
def ag_completion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    answer = F.when(k == 1, "ANSWER_READY").when(k == 2, "NO_ANSWER_CONTENT").when(k == 3, "FAILED")
    return table(spark, d, "orders").select("o_orderkey", audit.completion_reason(F.when(k == 4, "FAILED").otherwise("DONE"), k, answer).alias("reason"))
