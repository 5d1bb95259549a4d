"""Views of the test tables as this library's inputs, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads: a conversation's first turn is a post, each further one a comment on the turn before."""
    c = table(spark, sf_dir, "conversations")
    s = lambda x: F.col(x).cast("string")
    return c.select(
        F.concat(F.lit("run-"), (F.col("conv_id") % 10).cast("string")).alias("run_id"),
        F.concat(s("conv_id"), F.lit("-"), s("turn")).alias("post_id"),
        F.when(F.col("turn") == 0, "POST").otherwise("COMMENT").alias("record_type"),
        F.when(F.col("turn") > 0, F.concat(s("conv_id"), F.lit("-"), (F.col("turn") - 1).cast("string"))).alias("parent_post_id"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("content_masked"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("ordinal"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search paths: a language is a run, a source a path; copies share their address, some records have none."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("run_id"),
        F.col("source").alias("path_id"),
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("post_id"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 17 != 0, F.concat(F.lit("https://x.example/"), F.md5("text"))).alias("source_url"),
        F.lit("POST").alias("record_type"),
        F.when(F.col("doc_id") % 3 == 0, "SEARCH_POSTS").when(F.col("doc_id") % 3 == 1, "SEARCH_IN_GROUP").otherwise("CRAWL_FEED").alias("source_type"),
        F.when(F.col("doc_id") % 5 == 0, "brand").when(F.col("doc_id") % 5 < 3, "question").otherwise("pain_point").alias("query_family"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a judgement from the labels table; unlabelled ones have none."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"), "quality", "toxic")
    c = candidates(spark, sf_dir).join(lab, "ordinal", "left")
    d = F.col("ordinal")
    decision = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "ACCEPTED").when(F.col("quality") == 0, "UNCERTAIN")
    reasons = (
        F.when(decision == "REJECTED", F.array(F.when(d % 3 == 0, "commercial_noise").when(d % 3 == 1, "target_weak_signal").otherwise("fee_unclear"), F.lit("low_signal")))
        .when(decision == "UNCERTAIN", F.array(F.lit("mixed_signal")))
        .otherwise(F.array().cast("array<string>"))
    )
    return c.select(
        "*",
        decision.alias("judge_decision"),
        F.when(d % 4 == 0, "ACCEPTED").when(d % 4 == 1, "UNCERTAIN").when(d % 4 == 2, "REJECTED").alias("pre_ai_status"),
        ((d % 100) / 100.0).alias("judge_relevance_score"),
        (((d * 7) % 100) / 100.0).alias("judge_confidence_score"),
        ((d % 50) / 50.0).alias("pre_ai_score"),
        reasons.alias("judge_reason_codes"),
        F.lit(None).cast("string").alias("content_masked"),
        F.concat(F.lit("s"), (d % 4).cast("string")).alias("step_run_id"),
        F.when(d % 6 == 0, "stop").when(d % 6 < 4, "continue").alias("batch_decision"),
        F.when(d % 7 < 5, "LABELED").otherwise("FALLBACK").alias("label_status"),
        F.when(d % 9 < 6, "primary").alias("provider_used"),
        (d % 8 == 0).alias("fallback_used"),
        (d % 10 == 0).alias("judge_used_image_understanding"),
        F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("crawled_at"),
    ).drop("quality", "toxic")


def label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a label for each labelled document."""
    lab = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    role = F.when(F.col("toxic") == 1, "seller_affiliate").when(d % 11 == 0, "community_admin").when(F.col("quality") == 0, "unknown").otherwise("end_user")
    one = lambda v: lab.select(
        F.concat(F.lit(f"l{v}-"), d.cast("string")).alias("label_id"), F.concat(F.lit("d"), d.cast("string")).alias("post_id"), role.alias("author_role"),
        F.when(d % 4 == v, "low").when(d % 4 == 3, "medium").otherwise("high").alias("user_feedback_relevance"), (((d + v) % 10) / 10.0).alias("label_confidence"),
        F.when(d % 6 == 0, "fallback").otherwise("heuristic").alias("label_source"), F.lit(v).alias("created_at"),
    )
    return one(1).unionByName(one(2))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("error", "CAPTCHA", "click", "RATE_LIMIT", "view", "SESSION_EXPIRED", "signup", "REDUCED_REACH", "purchase", "MANUAL_RESET")])
    return e.select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("signal_id"), kind[F.col("event_type")].alias("signal_type"), F.col("ts").cast("timestamp").alias("detected_at"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(table(spark, sf_dir, "events"))


def progress_of(e: DataFrame) -> DataFrame:
    """Events as progress of steps; also of a stream."""
    return e.select(
        F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 5).cast("string").alias("step_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(F.col("event_id") % 3 != 0, F.floor("value")).cast("long").alias("collected"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") / 2)).cast("long").alias("persisted"),
        F.from_json("props", "k int")["k"].cast("long").alias("images"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("activity"),
        F.when(F.col("event_id") % 7 == 0, F.slice(F.array(*[F.concat_ws("-", "event_type", F.lit(k)) for k in range(1, 6)]), 1, (F.col("event_id") % 5).cast("int"))).alias("samples"),
    )


SQL = {
    "posts": """posts AS (
        SELECT 'run-' || (conv_id % 10) AS run_id, conv_id || '-' || turn AS post_id, CASE WHEN turn = 0 THEN 'POST' ELSE 'COMMENT' END AS record_type,
               CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_post_id, text AS content, conv_id * 100 + turn AS ordinal, conv_id, turn FROM conversations)""",
    "candidates": """candidates AS (
        SELECT lang AS run_id, source AS path_id, doc_id AS ordinal, 'd' || doc_id AS post_id, text AS content,
               CASE WHEN doc_id % 17 <> 0 THEN 'https://x.example/' || md5(text) END AS source_url, 'POST' AS record_type,
               CASE doc_id % 3 WHEN 0 THEN 'SEARCH_POSTS' WHEN 1 THEN 'SEARCH_IN_GROUP' ELSE 'CRAWL_FEED' END AS source_type,
               CASE WHEN doc_id % 5 = 0 THEN 'brand' WHEN doc_id % 5 < 3 THEN 'question' ELSE 'pain_point' END AS query_family FROM documents)""",
    "judged": """judged AS (
        SELECT c.*, CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'ACCEPTED' WHEN quality = 0 THEN 'UNCERTAIN' END AS judge_decision,
               CASE ordinal % 4 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'REJECTED' END AS pre_ai_status,
               (ordinal % 100) / 100.0::DOUBLE AS judge_relevance_score, ((ordinal * 7) % 100) / 100.0::DOUBLE AS judge_confidence_score, (ordinal % 50) / 50.0::DOUBLE AS pre_ai_score,
               CASE WHEN toxic = 1 THEN [CASE ordinal % 3 WHEN 0 THEN 'commercial_noise' WHEN 1 THEN 'target_weak_signal' ELSE 'fee_unclear' END, 'low_signal']
                    WHEN quality = 0 THEN ['mixed_signal'] ELSE [] END AS judge_reason_codes,
               's' || (ordinal % 4) AS step_run_id, CASE WHEN ordinal % 6 = 0 THEN 'stop' WHEN ordinal % 6 < 4 THEN 'continue' END AS batch_decision,
               CASE WHEN ordinal % 7 < 5 THEN 'LABELED' ELSE 'FALLBACK' END AS label_status, CASE WHEN ordinal % 9 < 6 THEN 'primary' END AS provider_used,
               ordinal % 8 = 0 AS fallback_used, ordinal % 10 = 0 AS judge_used_image_understanding, 1704067200 + ordinal * 60 AS crawled_s
        FROM candidates c LEFT JOIN labels l ON l.doc_id = c.ordinal)""",
    "label_history": """label_history AS (
        SELECT 'l' || v || '-' || doc_id AS label_id, 'd' || doc_id AS post_id,
               CASE WHEN toxic = 1 THEN 'seller_affiliate' WHEN doc_id % 11 = 0 THEN 'community_admin' WHEN quality = 0 THEN 'unknown' ELSE 'end_user' END AS author_role,
               CASE WHEN doc_id % 4 = v THEN 'low' WHEN doc_id % 4 = 3 THEN 'medium' ELSE 'high' END AS user_feedback_relevance, ((doc_id + v) % 10) / 10.0::DOUBLE AS label_confidence,
               CASE WHEN doc_id % 6 = 0 THEN 'fallback' ELSE 'heuristic' END AS label_source, v AS created_at FROM labels, (VALUES (1), (2)) t(v))""",
    "signals": """signals AS (
        SELECT user_id::VARCHAR AS account, event_id AS signal_id, CASE event_type WHEN 'error' THEN 'CAPTCHA' WHEN 'click' THEN 'RATE_LIMIT' WHEN 'view' THEN 'SESSION_EXPIRED'
               WHEN 'signup' THEN 'REDUCED_REACH' WHEN 'purchase' THEN 'MANUAL_RESET' END AS signal_type, ts AS detected_at FROM events)""",
    "progress": """progress AS (
        SELECT user_id::VARCHAR AS run_id, (event_id % 5)::VARCHAR AS step_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN floor(value)::BIGINT END AS collected,
               CASE WHEN event_id % 2 = 0 THEN floor(value / 2)::BIGINT END AS persisted, (props->>'k')::BIGINT AS images, CASE WHEN event_id % 4 <> 0 THEN event_type END AS activity,
               CASE WHEN event_id % 7 = 0 THEN list_transform(range(1, event_id % 5 + 1), lambda k: event_type || '-' || k) END AS samples FROM events)""",
}


def with_views(*names: str) -> str:
    """The head of a query over some views, in order."""
    return "WITH " + ", ".join(SQL[n] for n in names)
