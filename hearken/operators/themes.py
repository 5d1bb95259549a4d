"""Themes of a run's answer: audience gate, exclusion counts, rule themes with quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import as_col, contains_any, let, mask_pii, normalize_light
from . import gates

FEW = "Fewer than 10 records: the themes are only indicative."


def rule_theme(content, comparison=T.THEME_COMPARISON, asks=("co ai", "khong"), pain=T.THEME_PAIN, positive=T.THEME_POSITIVE) -> Column:
    """Struct ``label, sentiment`` of a text by markers, first that fits."""
    raw = F.coalesce(as_col(content), F.lit(""))
    t = lambda label, mood: F.struct(F.lit(label).alias("label"), F.lit(mood).alias("sentiment"))
    return let(
        normalize_light(raw),
        lambda x: F.when(contains_any(x, comparison), t("comparison", "neutral"))
        .when(raw.contains("?") | contains_any(x, asks) | x.startswith("hoi"), t("question", "neutral"))
        .when(contains_any(x, pain), t("pain_point", "negative"))
        .when(contains_any(x, positive), t("positive_feedback", "positive"))
        .otherwise(t("other", "neutral")),
    )


def with_exclusion(posts: DataFrame, labels: DataFrame, audience: str = "end_user_only", mode: str = "strict") -> DataFrame:
    """Posts left joined with their current labels, with ``reason`` why they are out of the answer (null: in)."""
    cols = ["author_role", "user_feedback_relevance", "label_confidence"]
    j = posts.join(labels.select(F.col("post_id").alias("_p"), *cols), F.col("post_id") == F.col("_p"), "left").drop("_p")
    out = F.when(~gates.eligible("judge_decision", "pre_ai_status", mode), "pre_ai_rejected")
    return j.withColumn("reason", F.coalesce(out, gates.audience_reason(*cols, audience)))


def exclusion_breakdown(gated: DataFrame) -> DataFrame:
    """One row a run: included, excluded, counts by reason (a map) and a warning for under ten records."""
    n = gated.groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    why = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    out = n.groupBy("run_id").agg(F.sum("n").alias("posts_crawled"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("posts_included"), why.alias("excluded_breakdown"))
    excluded = F.col("posts_crawled") - F.col("posts_included")
    return out.withColumns({"posts_excluded": excluded, "excluded_by_label_count": excluded, "warning": F.when(F.col("posts_included") < 10, FEW)})


def theme_summary(included: DataFrame, order: list[str], quotes: int = 3, quote_chars: int = 200, **markers) -> DataFrame:
    """One row a run and theme: sentiment, count, the first quotes (masked), and its place by count, ties to the one seen first."""
    t = included.withColumn("_t", rule_theme("content", **markers)).select("run_id", "content", *order, "_t.label", "_t.sentiment")
    w = Window.partitionBy("run_id", "label").orderBy(*order)
    at = F.struct(*order)
    counts = t.groupBy("run_id", "label").agg(F.first("sentiment").alias("dominant_sentiment"), F.count(F.lit(1)).alias("post_count"), F.min(at).alias("_first"))
    firsts = t.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= quotes)
    said = firsts.groupBy("run_id", "label").agg(F.sort_array(F.collect_list(F.struct("_n", mask_pii(F.substring("content", 1, quote_chars)).alias("q")))).alias("_q"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("post_count"), "_first"))
    out = counts.join(said, ["run_id", "label"]).withColumns({"sample_quotes": F.col("_q.q"), "rank": place})
    return out.select("run_id", "label", "dominant_sentiment", "post_count", "sample_quotes", "rank")
