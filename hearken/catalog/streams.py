"""Queries of streams: each runs the stream over the table to its end, or its batch twin where SQL checks it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import lit_profile, normalized_profile
from ..sources import tables
from ..streaming import gating, health, progress
from ..views import progress as progress_view
from ..views import progress_of, signals, table, with_views
from .gating import ANCHORS, GATE, MARKERS, NEGATIVE, RELATED, stop_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shared(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="hearken-")).rstrip("/")


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The rows that a stream appends until its source is read."""
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").outputMode("append").format("parquet")
    out.start(f"{at}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def drain_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    # a file or a folder of files: both are read as a glob of the folder above
    src = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return src.load(path if table_is_folder(spark, path) else f"{sf_dir}/{name}*.parquet")


def drain(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run ``build`` over a table as a stream until all of it is read; the sink's rows."""
    stream = build(drain_source(spark, sf_dir, name))
    if mode == "append":
        return finished(spark, stream)
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    # update mode: each trigger's rows replace those before it
    out.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("_trigger", F.lit(i)).write.mode("append").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def table_is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


WALK = """, o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY detected_at, signal_id) AS rn FROM signals),
    b AS (SELECT *, CASE signal_type WHEN 'CAPTCHA' THEN 'BLOCKED' WHEN 'RATE_LIMIT' THEN 'CAUTION' WHEN 'REDUCED_REACH' THEN 'CAUTION' WHEN 'MANUAL_RESET' THEN 'HEALTHY' END AS st FROM o),
    w AS (SELECT account, rn, signal_id, signal_type, 'HEALTHY' AS status_before, CASE WHEN st IS NULL THEN 'CAUTION' ELSE st END AS status_after, signal_type = 'SESSION_EXPIRED' AS expired,
            CASE signal_type WHEN 'CAPTCHA' THEN detected_at + INTERVAL 24 HOUR WHEN 'RATE_LIMIT' THEN detected_at + INTERVAL 1 HOUR WHEN 'REDUCED_REACH' THEN detected_at + INTERVAL 1 HOUR END AS cool FROM b WHERE rn = 1
        UNION ALL
        SELECT b.account, b.rn, b.signal_id, b.signal_type, CASE WHEN w.expired AND w.status_after = 'HEALTHY' THEN 'CAUTION' ELSE w.status_after END,
            CASE WHEN b.st IS NOT NULL THEN b.st WHEN w.status_after = 'HEALTHY' THEN 'CAUTION' ELSE w.status_after END, w.expired OR b.signal_type = 'SESSION_EXPIRED',
            CASE b.signal_type WHEN 'CAPTCHA' THEN b.detected_at + INTERVAL 24 HOUR WHEN 'RATE_LIMIT' THEN b.detected_at + INTERVAL 1 HOUR WHEN 'REDUCED_REACH' THEN b.detected_at + INTERVAL 1 HOUR WHEN 'SESSION_EXPIRED' THEN w.cool END
        FROM w JOIN b ON b.account = w.account AND b.rn = w.rn + 1)"""
HEALTH = "WITH RECURSIVE " + with_views("signals").removeprefix("WITH ") + WALK


@query(HEALTH + " SELECT signal_id, status_before, status_after, CASE WHEN expired THEN 'EXPIRED' ELSE 'NOT_SETUP' END AS session_status, epoch_us(cool) AS cooldown FROM w")
def st_health_batch(spark: SparkSession, d: str) -> DataFrame:
    h = health.health_log(signals(spark, d))
    return h.select("signal_id", "status_before", "status_after", "session_status", F.unix_micros("cooldown_until").alias("cooldown"))


@query(SQL["st_health_batch"])
def st_health_stream(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("error", "CAPTCHA", "click", "RATE_LIMIT", "view", "SESSION_EXPIRED", "signup", "REDUCED_REACH", "purchase", "MANUAL_RESET")])
    build = lambda e: health.stream_health_log(e.select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("signal_id"), kind[F.col("event_type")].alias("signal_type"), F.col("ts").cast("timestamp").alias("detected_at")))
    h = drain(spark, d, "events", build)
    return h.select("signal_id", "status_before", "status_after", "session_status", F.unix_micros("cooldown_until").alias("cooldown"))


@query(SQL["st_health_batch"])
def st_health_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The older half of the signals as a batch, whose last states start a stream over the rest."""
    s = signals(spark, d)
    lo, hi = s.agg(F.min(F.unix_micros("detected_at")), F.max(F.unix_micros("detected_at"))).first()
    old = F.unix_micros("detected_at") <= F.lit(((lo or 0) + (hi or 0)) // 2)
    at = f"{shared(spark)}/signals-{uuid.uuid4().hex}"
    s.filter(~old).write.parquet(at)
    first = health.health_log(s.filter(old))
    rest = finished(spark, health.stream_health_log(tables.stream_table(spark, at, s.schema), start=health.states_after(first)))
    return first.unionByName(rest).select("signal_id", "status_before", "status_after", "session_status", F.unix_micros("cooldown_until").alias("cooldown"))


@query(HEALTH + """, l AS (SELECT *, CASE WHEN expired AND status_after = 'HEALTHY' THEN 'CAUTION' ELSE status_after END AS hs, row_number() OVER (PARTITION BY account ORDER BY rn DESC) AS back FROM w)
    SELECT account, hs AS health_status, false AS runnable, CASE WHEN expired THEN 'REAUTH_REQUIRED' ELSE 'CONNECT_ACCOUNT' END AS action_required, coalesce(cool <= TIMESTAMP '2024-01-31 00:00:00', false) OR hs = 'HEALTHY' AS write_allowed,
        NOT (hs = 'BLOCKED' AND coalesce(cool > TIMESTAMP '2024-01-31 00:00:00', false)) AS reset_allowed FROM l WHERE back = 1""")
def st_account_state(spark: SparkSession, d: str) -> DataFrame:
    s = health.derived(health.latest_state(health.health_log(signals(spark, d))), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return s.select("account", "health_status", "runnable", "action_required", "write_allowed", "reset_allowed")


def _stream_candidates(docs: DataFrame) -> DataFrame:
    """The candidates' mapping over a stream of documents."""
    n = F.col("doc_id")
    return docs.select(
        F.col("lang").alias("run_id"), F.col("source").alias("path_id"), n.alias("ordinal"), F.concat(F.lit("d"), n.cast("string")).alias("post_id"), F.col("text").alias("content"),
        F.when(n % 17 != 0, F.concat(F.lit("https://x.example/"), F.md5("text"))).alias("source_url"), F.lit("POST").alias("record_type"), F.lit("CRAWL_FEED").alias("source_type"), F.lit("question").alias("query_family"),
        F.timestamp_seconds(F.lit(1704067200)).alias("seen_at"),
    )


@query(with_views("candidates") + " SELECT run_id, count(DISTINCT coalesce(source_url, post_id)) AS kept FROM candidates GROUP BY 1")
def st_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Documents in four files, one a trigger, with times that move on by a minute each."""
    at = f"{shared(spark)}/seen-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    docs.repartition(4, "doc_id").write.parquet(at)
    seen = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("ordinal"))
    stream = _stream_candidates(tables.stream_table(spark, at, docs.schema, files_per_trigger=1)).withColumn("seen_at", seen)
    kept = finished(spark, gating.dedupe_stream(stream, "seen_at", "4000 days").select("run_id", "post_id"))
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"{with_views('candidates')}, {GATE} SELECT run_id, ordinal, decision, decision = 'REJECTED' AS is_excluded FROM verdicts")
def st_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every document through the gate as a stream."""
    none = F.array().cast("array<string>")
    spec = F.struct(F.lit("").alias("research_objective"), none.alias("target_signal_types"), none.alias("target_author_types"), none.alias("non_target_author_types"), none.alias("hard_reject_signals"), F.struct(F.lit(8).alias("minimum_comment_text_length"), F.lit(True).alias("reject_transactional_only_comments")).alias("comment_policy"))
    contexts = table(spark, d, "documents").select(F.col("lang").alias("run_id")).distinct().select("run_id", normalized_profile(lit_profile(ANCHORS, RELATED, NEGATIVE)).alias("profile"), spec.alias("spec"))
    text = F.lit(None).cast("string")
    build = lambda s: gating.gate_stream(_stream_candidates(s).withColumns({"source_group_name": text, "parent_text": text, "parent_status": text}), contexts, **MARKERS).select("run_id", "ordinal", "judge.decision", "is_excluded")
    return drain(spark, d, "documents", build)


STREAMED = """j AS (SELECT user_id::VARCHAR AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o, CASE WHEN user_id % 3 = 0 THEN 'REJECTED' WHEN event_type = 'error' THEN 'ACCEPTED' WHEN event_type IN ('view', 'click') THEN 'UNCERTAIN' ELSE 'REJECTED' END AS d, value % 1 AS rel FROM events),
    h AS (SELECT path_id, (o - 1) // 20 + 1 AS batch_index, count(*) AS batch_size, count(*) FILTER (d = 'ACCEPTED') AS acc, count(*) FILTER (d = 'UNCERTAIN') AS unc, count(*) FILTER (d = 'ACCEPTED' AND rel >= 0.8::DOUBLE * 0.6::DOUBLE) AS high FROM j GROUP BY ALL HAVING count(*) = 20),
    hd AS (SELECT *, CASE WHEN acc / batch_size >= 0.15 OR high / batch_size >= 0.05 THEN 'continue' WHEN unc / batch_size >= 0.25 THEN 'reformulate' ELSE 'weak' END AS decision FROM h)"""


@query(stop_sql(STREAMED, 60) + """ SELECT path_id, w.batch_index::INT AS batch_index, w.batch_size, w.acc AS accepted_count, unc AS uncertain_count, high AS high_conf_accept_count, w.decision,
    CASE WHEN stop_reason IS NOT NULL THEN 'stop' WHEN ended THEN 'reformulate' ELSE 'continue' END AS batch_decision, stop_reason, ta::BIGINT AS total_accepted, ts::BIGINT AS total_scanned FROM walk w JOIN hd USING (path_id, batch_index)""")
def st_stop_rules(spark: SparkSession, d: str) -> DataFrame:
    """Stop rules on a stream of judged records; paths are users of the events, so that ordinals have no gaps."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    decision = F.when(F.col("event_type") == "error", "ACCEPTED").when(F.col("event_type").isin("view", "click"), "UNCERTAIN").otherwise("REJECTED")
    j = e.select(F.col("user_id").cast("string").alias("path_id"), F.row_number().over(w).cast("long").alias("ordinal"), F.when(F.col("user_id") % 3 == 0, "REJECTED").otherwise(decision).alias("decision"), (F.col("value") % 1).alias("relevance_score"), F.lit(0.8).alias("confidence_score"))
    at = f"{shared(spark)}/judged-{uuid.uuid4().hex}"
    j.repartition(4).write.parquet(f"{at}/judged.parquet")
    return drain(spark, at, "judged", gating.stop_stream).filter("given_up is null").drop("given_up")


LAST = with_views("progress") + ", h AS (SELECT run_id, step_id, max(ts) AS hb, arg_max(collected, event_id) FILTER (collected IS NOT NULL) AS c, arg_max(persisted, event_id) FILTER (persisted IS NOT NULL) AS p, arg_max(images, event_id) FILTER (images IS NOT NULL) AS i, arg_max(activity, event_id) FILTER (activity IS NOT NULL) AS activity, arg_max(samples, event_id) FILTER (samples IS NOT NULL) AS s FROM progress GROUP BY ALL)" + """
    SELECT run_id, step_id, coalesce(c, 0) AS collected_count, coalesce(p, 0) AS persisted_count, greatest(coalesce(c, 0) - coalesce(p, 0), 0) AS lost_before_persist_count, coalesce(i, 0) AS image_candidate_count, coalesce(c, 0) > 0 OR coalesce(len(s), 0) > 0 AS salvage_available, activity, coalesce(array_to_string(s[1:3], ','), '') AS samples FROM h"""
STUCK_COLUMNS = ("run_id", "step_id", "collected_count", "persisted_count", "lost_before_persist_count", "image_candidate_count", "salvage_available", "activity")


@query(LAST + " WHERE (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(hb)) / 1e6 > 86400")
def st_stuck_steps(spark: SparkSession, d: str) -> DataFrame:
    s = progress.stuck_steps(progress.latest_progress(progress_view(spark, d)), F.lit("2024-01-31 00:00:00").cast("timestamp"), 86400)
    return s.select(*STUCK_COLUMNS, F.array_join("samples", ",").alias("samples"))


@query(LAST + " WHERE epoch_ms(hb) + 86400000 < (SELECT epoch_ms(max(ts)) FROM events)")
def st_stuck_steps_stream(spark: SparkSession, d: str) -> DataFrame:
    """Steps that the newest event leaves more than a day behind, as the stream reports them."""
    return drain(spark, d, "events", lambda e: progress.stream_stuck_steps(progress_of(e), 86400)).select(*STUCK_COLUMNS, F.array_join("samples", ",").alias("samples"))


@query("""SELECT user_id, count(*) AS events, max(event_id) AS last_event FROM (SELECT *, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM events) WHERE ended = 0 GROUP BY 1""")
def st_event_feed(spark: SparkSession, d: str) -> DataFrame:
    f = progress.feed_until_end(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["error"])
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"))


@query("""SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS position, event_id, kind FROM (SELECT user_id::VARCHAR AS run_id, epoch_us(ts) AS us, event_id, event_type AS kind,
    coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM events) WHERE ended = 0""")
def st_event_feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The feed of every run as a stream whose files come out of order, one a trigger; a last file moves the watermark past all."""
    at = f"{shared(spark)}/feed-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"))
    lo, hi = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    parts, width = 6, ((hi or 0) - (lo or 0)) // 6 + 1
    part = F.least(F.floor((F.unix_seconds("ts") - F.lit(lo)) / width), F.lit(parts - 1))
    for k in (1, 0, 3, 2, 5, 4):
        e.filter(part == k).coalesce(1).write.mode("append").parquet(at)
    e.select(F.lit("").alias("run_id"), (F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("kind")).write.mode("append").parquet(at)
    feed = progress.stream_feed(tables.stream_table(spark, at, e.schema, files_per_trigger=1), f"{2 * width} seconds", ["error"])
    return finished(spark, feed).filter("run_id <> ''").select("run_id", "position", "event_id", "kind")


@query("SELECT user_id::VARCHAR AS run_id, event_type AS pre_ai_status, count(*) AS count FROM events GROUP BY ALL")
def st_live_counters(spark: SparkSession, d: str) -> DataFrame:
    c = drain(spark, d, "events", lambda e: gating.run_counters(e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("pre_ai_status"))), "update")
    return c.groupBy("run_id", "pre_ai_status").agg(F.max_by("count", "_trigger").alias("count"))
