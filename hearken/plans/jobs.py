"""End-to-end jobs: gate a crawl, label the survivors, answer a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, batches, closeout, dedupe, labels, scoring, themes, threads


def gate_crawl(candidates: DataFrame, contexts: DataFrame, stored: DataFrame | None = None, batch_size: int = 20, path: list[str] | None = None, markers: dict | None = None, **rules) -> tuple[DataFrame, DataFrame]:
    """Records to store and the summary of each processed batch.

    ``candidates``: ``run_id, path_id, ordinal, post_id, content, source_url, …``; ``contexts``: one small row a run with its
    normalized profile and spec. Health is taken before duplicates go, so they count in ratios; records after the first
    stop of a path are never stored. ``stored``: records of earlier steps, for parents and ids.
    """
    path = path or ["run_id", "path_id"]
    c = candidates.join(contexts, "run_id", "left")
    c = threads.parent_context(c, stored) if stored is not None else c.withColumns({"parent_text": F.lit(None).cast("string"), "parent_status": F.lit(None).cast("string")})
    gated = batches.assign_batches(scoring.gate_records(c, **(markers or {})), path, ["ordinal"], batch_size)
    key = [*path, "batch_index"]
    health = batches.batch_health_v2(gated.select(*key, "judge.*"), key)
    summaries = batches.apply_stop_rules(health, path, **rules)
    kept = gated.join(summaries.select(*key, "batch_decision"), key)
    kept = dedupe.keep_first(kept, "run_id", [x for x in key if x != "run_id"], ["ordinal", "post_id"])
    if stored is not None:
        kept = dedupe.rename_collisions(dedupe.new_only(kept, stored), stored, ["ordinal"])
    return kept.drop("profile", "spec"), summaries


def label_run(posts: DataFrame, mode: str = "strict", scored: DataFrame | None = None, **markers) -> tuple[DataFrame, DataFrame]:
    """Labels of eligible records, and the summary of each run's job. Only eligible records are parents of a thread."""
    from ..operators.gates import eligible

    ok = posts.filter(eligible("judge_decision", "pre_ai_status", mode))
    out = labels.label_records(threads.thread_context(ok), scored, **markers)
    flat = out.select("run_id", "post_id", "label.*")
    return flat, labels.label_job_summary(posts, flat, mode)


def answer_run(posts: DataFrame, current: DataFrame, order: list[str], audience: str = "end_user_only", mode: str = "strict", **markers) -> tuple[DataFrame, DataFrame]:
    """Themes of each run, and its exclusion counts with ``answer_status``."""
    gated = themes.with_exclusion(posts, current, audience, mode)
    found = themes.theme_summary(gated.filter("reason is null"), order, **markers)
    counts = themes.exclusion_breakdown(gated)
    has = found.select("run_id").distinct().withColumn("_has", F.lit(True))
    status = F.when(F.col("_has"), "ANSWER_READY").otherwise("NO_ANSWER_CONTENT")
    return found, counts.join(has, "run_id", "left").withColumn("answer_status", status).drop("_has")


def audit_runs(runs: DataFrame, posts: DataFrame, steps: DataFrame, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of an audit."""
    return {
        "breakdowns": audit.run_breakdowns(posts),
        "top_records": audit.top_records(posts),
        "yield": audit.gating_yield(posts),
        "analysis": audit.run_analysis(runs, posts, steps, found),
        "exhausted": closeout.exhaustion(steps.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id")),
    }
