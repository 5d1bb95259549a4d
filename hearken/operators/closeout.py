"""Why a run found no answer: search metrics from checkpoints, exhaustion, reasons, near misses, one payload a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import let
from .dedupe import top_k_first_seen

ATTEMPT = "struct<query:string,collected_count:long,accepted_count:long,stop_reason:string,reason_cluster:string,reformulated_queries:array<string>,used_reformulation:boolean>"
BATCH = "struct<batch_index:int,batch_size:long,accepted_count:long,batch_decision:string,decision:string,reason_cluster:string,stop_reason:string>"
SUMMARY = "struct<trigger:string,completed_search_steps:long,zero_accept_search_steps:long,scanned_records:long,dominant_reason_cluster:string,dominant_stop_reason:string>"
CHECKPOINT = (
    f"struct<phase:string,step_id:string,collected_count:long,skip_reason:string,heartbeat_at:string,query_attempts:array<{ATTEMPT}>,batch_summaries:array<{BATCH}>,"
    f"exhaustion_summary:{SUMMARY},progress:struct<collected_count:long,persisted_count:long,activity:string>,"
    "salvage:struct<available:boolean,collected_count:long,persisted_count:long,lost_before_persist_count:long,image_candidate_count:long>>"
)
STEP_ORDER = ("step_order", "started_at", "step_run_id")


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _total(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0)))


def _filled(items: Column, field: str) -> Column:
    return F.filter(F.transform(items, lambda x: x[field]), lambda v: F.coalesce(v, F.lit("")) != "")


def search_step_metrics(steps: DataFrame) -> DataFrame:
    """Add ``accepted, scanned, reason_clusters, stop_reasons`` to steps with ``checkpoint`` (struct) and ``actual_count``.

    Without attempts the counts come from the batches; a zero falls through to the next source. Clusters and reasons are
    listed from attempts and batches alike, so one stop is listed twice.
    """
    a, b = _list(F.col("checkpoint.query_attempts"), ATTEMPT), _list(F.col("checkpoint.batch_summaries"), BATCH)
    some = F.size(a) > 0
    fallback = F.coalesce(F.nullif(F.col("checkpoint.collected_count"), F.lit(0)), F.nullif(F.col("actual_count").cast("long"), F.lit(0)), _total(b, "batch_size"))
    return steps.withColumns(
        {
            "accepted": F.when(some, _total(a, "accepted_count")).otherwise(_total(b, "accepted_count")),
            "scanned": F.when(some, _total(a, "collected_count")).otherwise(fallback),
            "reason_clusters": F.concat(_filled(a, "reason_cluster"), _filled(b, "reason_cluster")),
            "stop_reasons": F.concat(_filled(a, "stop_reason"), _filled(b, "stop_reason")),
        }
    )


def exhaustion(steps: DataFrame, min_steps: int = 2, min_scanned: int = 120, weak_clusters: Sequence[str] = T.WEAK_CLUSTERS, weak_stops: Sequence[str] = T.WEAK_STOPS) -> DataFrame:
    """Runs that should give up: steps still pending, nothing accepted, enough searched, and for weak reasons.

    ``steps``: ``run_id, run_status, step_run_id, step_id, step_order, started_at, action_type, status, actual_count,
    checkpoint``. One row a run that fires: the summary and the steps to skip. The dominant cluster and reason are the most
    common ones, ties to the one seen first. One pass over the steps: each becomes a row of its own and one for each cluster
    and reason that it lists; these are counted per run and value, then put together per run.
    """
    live = ~F.col("run_status").isin("DONE", "FAILED", "CANCELLED")
    searched = search_step_metrics(steps.filter(live))
    counts = F.coalesce((F.col("status") == "DONE") & F.col("action_type").isin(*T.SEARCH_ACTIONS) & (F.col("scanned") > 0), F.lit(False))
    listed = lambda kind, c: F.when(counts, F.transform(c, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("v"), i.alias("i")))).otherwise(F.expr("cast(array() as array<struct<kind:string,v:string,i:int>>)"))
    itself = F.array(F.struct(F.lit("step").alias("kind"), F.lit(None).cast("string").alias("v"), F.lit(0).alias("i")))
    rows = searched.select(
        "run_id", F.struct(*STEP_ORDER).alias("_s"), "accepted", "scanned", counts.alias("_counts"),
        F.when(F.col("status") == "PENDING", F.struct("step_order", "step_id")).alias("_pending"),
        F.coalesce((F.col("status") == "SKIPPED") & (F.col("checkpoint.skip_reason") == "goal_aware_exhaustion"), F.lit(False)).alias("_fired"),
        F.explode(F.concat(itself, listed("cluster", F.col("reason_clusters")), listed("stop", F.col("stop_reasons")))).alias("e"),
    )
    step = (F.col("kind") == "step") & F.col("_counts")
    each = rows.select("*", "e.kind", "e.v").groupBy("run_id", "kind", "v").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_s", "e.i")).alias("_at"),
        F.count_if(step).alias("steps"), F.count_if(step & (F.col("accepted") == 0)).alias("zero"), F.sum(F.when(step, F.col("accepted"))).alias("accepted"), F.sum(F.when(step, F.col("scanned"))).alias("scanned"),
        F.collect_list(F.when(F.col("kind") == "step", F.col("_pending"))).alias("_pending"), F.max(F.col("_fired")).alias("_fired"),
    )
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct(-F.col("n"), "_at", "v")))["v"]
    t = each.groupBy("run_id").agg(
        F.sum("steps").alias("completed_search_steps"), F.sum("zero").alias("zero_accept_search_steps"), F.sum("accepted").alias("_accepted"), F.sum("scanned").alias("scanned_records"),
        first("cluster").alias("dominant_reason_cluster"), first("stop").alias("dominant_stop_reason"), F.max((F.col("kind") == "stop") & F.col("v").isin(*weak_stops)).alias("_weak"),
        F.sort_array(F.flatten(F.collect_list("_pending"))).alias("_pending"), F.max("_fired").alias("_fired"),
    )
    fire = (F.size("_pending") > 0) & ~F.col("_fired") & (F.col("_accepted") == 0) & (F.col("completed_search_steps") >= max(1, min_steps)) & (F.col("scanned_records") >= max(20, min_scanned))
    fire &= F.coalesce(F.col("dominant_reason_cluster").isin(*weak_clusters), F.lit(False)) | F.coalesce("_weak", F.lit(False))
    return t.filter(fire).select(
        "run_id", F.lit("goal_aware_exhaustion").alias("trigger"), "completed_search_steps", "zero_accept_search_steps", "scanned_records", "dominant_reason_cluster", "dominant_stop_reason",
        F.col("_pending.step_id").alias("skipped_step_ids"),
    )


def skip_steps(steps: DataFrame, fired: DataFrame) -> DataFrame:
    """Pending steps of fired runs become SKIPPED."""
    hit = fired.select("run_id", F.lit(True).alias("_f"))
    return steps.join(hit, "run_id", "left").withColumn("status", F.when(F.col("_f") & (F.col("status") == "PENDING"), "SKIPPED").otherwise(F.col("status"))).drop("_f")


def attempted_queries(steps: DataFrame) -> DataFrame:
    """One row an attempt of the finished search steps: ``run_id, ordinal, …``; a step without attempts is one of its own."""
    c = F.col("checkpoint")
    a, b = _list(c["query_attempts"], ATTEMPT), _list(c["batch_summaries"], BATCH)
    first = lambda f: F.try_element_at(_filled(b, f), F.lit(1))
    own = F.struct(
        F.col("target").alias("query"), F.coalesce(F.nullif(c["collected_count"], F.lit(0)), F.col("actual_count").cast("long"), F.lit(0)).alias("collected_count"),
        _total(b, "accepted_count").alias("accepted_count"), first("stop_reason").alias("stop_reason"), first("reason_cluster").alias("reason_cluster"),
        F.array().cast("array<string>").alias("reformulated_queries"), F.lit(False).alias("used_reformulation"),
    ).cast(ATTEMPT)
    done = steps.filter((F.col("status") == "DONE") & F.col("action_type").isin(*T.SEARCH_ACTIONS))
    each = done.select("run_id", "step_id", "action_type", "target", F.struct("started_at", "step_run_id").alias("_s"), F.posexplode(F.when(F.size(a) > 0, a).otherwise(F.array(own))).alias("_i", "x"))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("_s", "_i"))
    return each.select(
        "run_id", n.alias("ordinal"), "step_id", "action_type", F.coalesce(F.nullif(F.col("x.query"), F.lit("")), F.col("target")).alias("query"), F.coalesce("x.collected_count", F.lit(0)).alias("collected_count"),
        F.coalesce("x.accepted_count", F.lit(0)).alias("accepted_count"), "x.stop_reason", "x.reason_cluster", F.coalesce("x.used_reformulation", F.lit(False)).alias("used_reformulation"),
    )


def reject_reasons(posts: DataFrame, k: int = 5) -> DataFrame:
    """The most common reason codes of each run, ties to the one seen first: ``run_id, reason_code, count, rank``."""
    each = posts.select("run_id", F.struct("ordinal").alias("_o"), F.posexplode("judge_reason_codes").alias("_i", "reason_code"))
    return top_k_first_seen(each.withColumn("_at", F.struct("_o", "_i")), ["run_id"], "reason_code", "_at", k)


def near_misses(posts: DataFrame, k: int = 3) -> DataFrame:
    """Records not accepted with the best scores; a judge's score of zero falls through to the earlier one."""
    d = F.coalesce(F.nullif(F.col("judge_decision"), F.lit("")), F.nullif(F.col("pre_ai_status"), F.lit("")), F.lit("UNKNOWN"))
    s = F.coalesce(F.nullif(F.col("judge_relevance_score"), F.lit(0.0)), F.nullif(F.col("pre_ai_score"), F.lit(0.0)), F.lit(0.0))
    text = F.substring(F.coalesce(F.nullif(F.col("content_masked"), F.lit("")), F.col("content"), F.lit("")), 1, 180)
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "ordinal"))
    r = posts.withColumns({"_d": d, "score": s}).filter("_d <> 'ACCEPTED'").withColumn("rank", rank).filter(F.col("rank") <= k)
    return r.select("run_id", "rank", "post_id", "record_type", "score", text.alias("content"), "source_url")


def next_actions(outcome: Column, cluster: Column, reason: Column, exhausted: Column) -> Column:
    """Codes of what to try next, at most three."""
    weak = F.coalesce(cluster.isin("generic_weak", "target_weak"), F.lit(False))
    promo = F.coalesce(cluster == "promo_noise", F.lit(False)) | F.coalesce(reason.isin("commercial_noise", "seller_cta"), F.lit(False))
    codes = F.array(
        F.when(exhausted, "switch_language_of_search"), F.when(weak, "broaden_retrieval_profile"), F.when(promo, "deprioritize_promotional_sources"),
        F.when(outcome == "NO_ANSWER_CONTENT", "review_answer_contract"),
    )
    return let(F.filter(codes, lambda c: c.isNotNull()), lambda a: F.when(F.size(a) == 0, F.array(F.lit("review_spec_and_queries"))).otherwise(F.slice(a, 1, 3)))


def no_answer_title(outcome: Column) -> Column:
    return F.when(outcome == "NO_ANSWER_CONTENT", "Accepted records did not converge into a final answer").otherwise("Run completed without usable evidence")


def no_answer_summary(outcome: Column, topic: Column, records: Column, searched: Column, exhausted: Column) -> Column:
    """One or two sentences on why there is no answer."""
    about = F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit(" for '"), topic, F.lit("'"))).otherwise("")
    ended = F.when(exhausted, "The run exhausted repeated weak search paths and stopped the remaining tail early.").otherwise("Labeling and theme synthesis were skipped.")
    return F.when(
        outcome == "NO_ANSWER_CONTENT",
        F.concat(F.lit("The run found candidate evidence"), about, F.lit(", but the accepted set still did not form a stable theme answer after labeling and synthesis.")),
    ).otherwise(F.format_string("No eligible evidence was found%s after %d search steps and %d persisted records. %s", about, searched, records, ended))


def no_answer_payload(runs: DataFrame, posts: DataFrame, steps: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """One row a run: title and summary, evidence counts, common reasons and clusters, attempted queries, near misses and next actions.

    ``runs``: ``run_id, topic, outcome_type``.
    """
    d = F.coalesce(F.nullif(F.col("judge_decision"), F.lit("")), F.nullif(F.col("pre_ai_status"), F.lit("")), F.lit("UNKNOWN"))
    ev = posts.withColumn("_d", d).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_records"), *[F.count_if(F.col("_d") == s).alias(f"{s.lower()}_count") for s in ("ACCEPTED", "REJECTED", "UNCERTAIN")])
    skipped = (F.col("status") == "SKIPPED") & (F.col("checkpoint.skip_reason") == "goal_aware_exhaustion")
    st = steps.groupBy("run_id").agg(
        F.count_if((F.col("status") == "DONE") & F.col("action_type").isin(*T.SEARCH_ACTIONS)).alias("search_steps_completed"), F.count_if(skipped).alias("search_steps_skipped"),
        F.max(F.coalesce(skipped & F.col("checkpoint.exhaustion_summary").isNotNull(), F.lit(False))).alias("goal_aware_exhausted"),
    )
    tried = attempted_queries(steps)
    gather = lambda t, cols, name: t.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    reasons = gather(reject_reasons(posts), ["rank", "reason_code", "count"], "_reasons")
    clusters = top_k_first_seen(tried.filter("reason_cluster <> ''"), ["run_id"], "reason_cluster", "ordinal", 5)
    clusters = gather(clusters, ["rank", "reason_cluster", "count"], "_clusters")
    queries = gather(tried.filter("ordinal <= 12"), ["ordinal", "query", "collected_count", "accepted_count", "stop_reason", "reason_cluster", "used_reformulation"], "attempted_queries")
    misses = gather(near_misses(posts), ["rank", "post_id", "record_type", "score", "content", "source_url"], "near_miss_records")
    out = runs
    for t in (ev, st, reasons, clusters, queries, misses):
        out = out.join(t, "run_id", "left")
    if themes is not None:
        out = out.join(themes.groupBy("run_id").agg(F.count(F.lit(1)).alias("theme_count")), "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    gone = F.coalesce("goal_aware_exhausted", F.lit(False))
    top = lambda c, f: F.try_element_at(F.col(c), F.lit(1))[f]
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    outcome = F.col("outcome_type")
    return out.select(
        "run_id", "topic", "outcome_type", no_answer_title(outcome).alias("title"), no_answer_summary(outcome, F.col("topic"), n("total_records"), n("search_steps_completed"), gone).alias("summary"),
        *[zero(c) for c in ("total_records", "accepted_count", "rejected_count", "uncertain_count", "search_steps_completed", "search_steps_skipped")],
        zero("theme_count") if themes is not None else F.lit(0).cast("long").alias("theme_count"), gone.alias("goal_aware_exhausted"),
        F.col("_reasons").alias("dominant_reject_reasons"), F.col("_clusters").alias("reason_clusters"), "attempted_queries", "near_miss_records",
        next_actions(F.col("outcome_type"), top("_clusters", "reason_cluster"), top("_reasons", "reason_code"), gone).alias("recommended_next_actions"),
        F.when(gone, "GOAL_AWARE_EXHAUSTION").alias("termination_reason"),
    )
