"""Roll-ups that audit runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import elapsed_seconds, parse_ts

#: The breakdowns of a run, each by some columns of its records.
BREAKDOWNS = {
    "by_status": ("record_type", "pre_ai_status"),
    "by_step": ("step_run_id", "record_type", "pre_ai_status"),
    "by_query_family": ("query_family", "pre_ai_status"),
    "by_batch_decision": ("batch_decision",),
    "by_label_status": ("label_status",),
    "by_provider": ("provider_used", "fallback_used"),
    "by_judge": ("decision", "used_image_understanding"),
}


def run_breakdowns(posts: DataFrame) -> DataFrame:
    """All breakdowns in one pass of grouping sets: ``breakdown, run_id,`` their columns (null where not used) and ``count``.

    Nulls among the values show as ``NULL``.
    """
    cols = sorted({c for v in BREAKDOWNS.values() for c in v})
    p = posts.withColumns(
        {
            "decision": F.coalesce("judge_decision", "pre_ai_status"),
            "used_image_understanding": F.col("judge_used_image_understanding").cast("string"),
            "fallback_used": F.col("fallback_used").cast("string"),
        }
    ).select("run_id", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in cols])
    sets = [[F.col("run_id"), *[F.col(c) for c in v]] for v in BREAKDOWNS.values()]
    g = p.groupingSets(sets, "run_id", *cols).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g"))
    # the leftmost grouping column is the highest bit; a bit is 1 where the column is not in the set
    ids = {name: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in v) for name, v in BREAKDOWNS.items()}
    name: Column | None = None
    for k, v in ids.items():
        name = F.when(F.col("_g") == v, k) if name is None else name.when(F.col("_g") == v, k)
    return g.select(name.alias("breakdown"), "run_id", *cols, "count")


def breakdown(all_: DataFrame, name: str) -> DataFrame:
    return all_.filter(F.col("breakdown") == name).select("run_id", *BREAKDOWNS[name], "count")


def _accepted() -> Column:
    return F.coalesce("judge_decision", "pre_ai_status") == "ACCEPTED"


def _times() -> list[Column]:
    return [F.min("crawled_at").alias("first_record_at"), F.min(F.when(_accepted(), F.col("crawled_at"))).alias("first_accepted_at"), F.max("crawled_at").alias("last_record_at")]


def _totals() -> list[Column]:
    return [F.count_if(F.col("pre_ai_status") == s).alias(f"{s.lower()}_total") for s in ("ACCEPTED", "UNCERTAIN", "REJECTED")]


def record_timing(posts: DataFrame) -> DataFrame:
    return posts.groupBy("run_id").agg(*_times())


def status_totals(posts: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return posts.groupBy(*by).agg(*_totals())


def top_records(posts: DataFrame, k: int = 25) -> DataFrame:
    """The best records of each run: accepted, uncertain, others; then by score, none last; then by id."""
    s = F.coalesce("judge_decision", "pre_ai_status", F.lit("NULL"))
    w = Window.partitionBy("run_id").orderBy(F.when(s == "ACCEPTED", 0).when(s == "UNCERTAIN", 1).otherwise(2), F.desc(F.coalesce("pre_ai_score", F.lit(-1.0))), "post_id")
    return posts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gating_yield(posts: DataFrame) -> DataFrame:
    """Counts and shares of each status by source type and query family, with subtotals (null: all)."""
    r = posts.withColumns({"source_type": F.coalesce("source_type", F.lit("NULL")), "query_family": F.coalesce("query_family", F.lit("NULL"))})
    n = r.rollup("source_type", "query_family").agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("pre_ai_status") == s).alias(s.lower()) for s in ("ACCEPTED", "UNCERTAIN", "REJECTED")])
    return n.withColumns({f"{s}_share": F.round(F.col(s) / F.col("records"), 4) for s in ("accepted", "uncertain", "rejected")})


def plan_estimate(steps: DataFrame) -> DataFrame:
    return steps.groupBy("plan_id").agg(
        F.coalesce(F.sum("estimated_duration_sec"), F.lit(0)).alias("estimated_total_duration_sec"), F.count_if(F.col("read_or_write") == "READ").alias("read_steps"), F.count_if(F.col("read_or_write") == "WRITE").alias("write_steps")
    )


def ordered_steps(step_runs: DataFrame, plan_steps: DataFrame) -> DataFrame:
    """Step runs with their plan's step, numbered in order of the plan, start and id."""
    j = step_runs.join(plan_steps, ["plan_id", "step_id"], "left")
    w = Window.partitionBy("run_id").orderBy(F.col("step_order").asc_nulls_last(), F.col("started_at").asc_nulls_last(), "step_run_id")
    return j.withColumn("position", F.row_number().over(w))


def latest_steps(step_runs: DataFrame) -> DataFrame:
    """The step of each run that started last, and the last heartbeat of all."""
    at = F.struct(F.col("started_at").isNotNull(), "started_at", "step_run_id")
    return step_runs.groupBy("run_id").agg(F.max_by("step_run_id", at).alias("latest_step_run_id"), F.max_by("status", at).alias("latest_status"), F.max("heartbeat_at").alias("last_heartbeat_at"))


CONCERNS = (
    "no_accepted_records", "uncertain_without_accepted", "weak_paths_continued", "steps_still_running", "failed_steps", "failure_class_set", "stop_not_converged",
    "answer_not_closed", "accepted_without_themes", "no_reformulation", "no_image_understanding", "timeout_without_salvage", "group_search_without_yield",
)


def run_analysis(runs: DataFrame, posts: DataFrame, steps: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """One row a run: totals, times to the first record and the first accepted one, steps by status, flags and concerns.

    ``runs``: ``run_id, status, failure_class, answer_status, started_at`` (ISO text); ``posts.crawled_at`` is a timestamp;
    ``steps``: ``run_id, step_run_id, action_type, status, actual_count, error_message, checkpoint`` (struct).
    """
    pictures = F.col("judge_used_image_understanding")
    p = posts.groupBy("run_id").agg(*_totals(), *_times(), F.count_if(pictures).alias("image_fallback_total"), F.count_if(pictures & _accepted()).alias("accepted_with_image"))
    by_step = posts.filter("pre_ai_status = 'ACCEPTED'").groupBy("run_id", "step_run_id").agg(F.count(F.lit(1)).alias("_acc"))
    s = steps.join(by_step, ["run_id", "step_run_id"], "left")
    c = F.col("checkpoint")
    has = lambda x: F.coalesce(x, F.lit(False))
    cond = lambda x: F.max(has(x))
    attempts = c["query_attempts"]
    st = s.groupBy("run_id").agg(
        *[F.count_if(F.col("status") == x).alias(f"{x.lower()}_steps") for x in ("DONE", "RUNNING", "PENDING", "FAILED")],
        F.count_if((F.col("status") == "FAILED") & c["salvage"]["available"]).alias("timeout_salvage_steps"),
        cond(F.exists(attempts, lambda a: has(a["used_reformulation"]) | (F.size(F.coalesce(a["reformulated_queries"], F.array().cast("array<string>"))) > 0))).alias("reformulation_observed"),
        cond(F.exists(attempts, lambda a: F.coalesce(a["reason_cluster"], F.lit("")) != "")).alias("reason_cluster_observed"),
        cond(F.exists(c["batch_summaries"], lambda b: F.coalesce(b["batch_decision"], b["decision"]) == "continue")).alias("_continued"),
        cond((F.col("status") == "FAILED") & (F.coalesce("error_message", F.lit("")) != "")).alias("_errors"),
        cond((F.col("status") == "FAILED") & (F.col("error_message") == "run has no crawled posts")).alias("_empty"),
        cond((F.col("action_type") == "CRAWL_COMMENTS") & (F.col("actual_count") == 0)).alias("_no_comments"),
        cond((F.col("status") == "DONE") & (F.col("action_type") == "SEARCH_IN_GROUP") & (F.coalesce("_acc", F.lit(0)) == 0) & (F.col("actual_count") > 0)).alias("_dry"),
    )
    out = runs
    for t in (p, st):
        out = out.join(t, "run_id", "left")
    out = out.join(themes.groupBy("run_id").agg(F.count(F.lit(1)).alias("theme_count")), "run_id", "left") if themes is not None else out.withColumn("theme_count", F.lit(0).cast("long"))
    counts = [x for x in out.columns if x.endswith(("_total", "_steps", "_count")) or x == "accepted_with_image"]
    flags = [x for x in out.columns if x.startswith("_") or x.endswith("_observed")]
    out = out.withColumns({x: F.coalesce(x, F.lit(0)) for x in counts} | {x: has(F.col(x)) for x in flags})
    start, none = parse_ts("started_at"), F.col("accepted_total") == 0
    tests = (
        none, (F.col("uncertain_total") > 0) & none, F.col("_continued") & none, F.col("running_steps") > 0, F.col("_errors"), F.coalesce("failure_class", F.lit("")) != "", F.col("status") == "CANCELLING",
        ~none & ~F.coalesce(F.col("answer_status").isin("ANSWER_READY", "NO_ANSWER_CONTENT"), F.lit(False)), ~none & (F.col("theme_count") == 0), none & ~F.col("reformulation_observed"), F.col("image_fallback_total") == 0,
        F.coalesce(F.col("failure_class") == "STEP_STUCK_TIMEOUT", F.lit(False)) & (F.col("timeout_salvage_steps") == 0), F.col("_dry"),
    )
    concerns = F.filter(F.array(*[F.when(t, n) for n, t in zip(CONCERNS, tests, strict=True)]), lambda x: x.isNotNull())
    return out.select(
        "run_id", "status", "failure_class", "answer_status", "accepted_total", "uncertain_total", "rejected_total", "theme_count", "image_fallback_total", "accepted_with_image",
        elapsed_seconds(start, F.col("first_record_at")).alias("time_to_first_record_sec"), elapsed_seconds(start, F.col("first_accepted_at")).alias("time_to_first_accepted_sec"),
        "done_steps", "running_steps", "pending_steps", "failed_steps", "timeout_salvage_steps", "reformulation_observed", "reason_cluster_observed",
        (F.col("_no_comments") & none).alias("comment_step_zero_after_no_accepts"), F.when(F.col("_empty") & none, "post_run_labeling_failed_on_zero_eligible_records").alias("failure_mode"), concerns.alias("concerns"),
    )


def completion_reason(status: Column, eligible: Column, answer_status: Column) -> Column:
    """Why a run that is over ended as it did, from its status, its eligible records and its answer."""
    done = (
        F.when(F.coalesce(eligible, F.lit(0)) == 0, "NO_ELIGIBLE_RECORDS")
        .when(answer_status == "ANSWER_READY", "ANSWER_READY")
        .when(answer_status == "NO_ANSWER_CONTENT", "LABELS_READY_NO_ANSWER")
        .when(answer_status == "FAILED", "ANSWER_CLOSEOUT_FAILED")
        .otherwise("COMPLETED")
    )
    return F.when(status == "DONE", done).when(status == "CANCELLED", "CANCELLED").when(status == "FAILED", "FAILED")
