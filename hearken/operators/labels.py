"""Labels of authors and intent: heuristics, a rule labeller, a slot for outside scorers, history and summaries."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import as_col, contains_any, let
from . import gates
from .scoring import clamp  # noqa: F401  (bounds of outside scores)

FIELDS = ("author_role", "content_intent", "commerciality_level", "user_feedback_relevance", "label_confidence", "label_reason", "label_source")


def _label(role, intent, commerciality, relevance, confidence, reason, source) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*[col(v).alias(k) for k, v in zip(FIELDS, (role, intent, commerciality, relevance, confidence, reason, source), strict=True)])


def pattern_hits(text: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """Struct of how many patterns of each family are found in a text, whatever the case."""
    low = F.lower(text)
    return F.struct(*[sum((low.rlike(f"(?iuU){p}").cast("int") for p in ps), F.lit(0)).alias(name) for name, ps in patterns.items()])


def heuristic_label(content, record_type, thread=None, url=None, patterns: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Struct ``label, direct, signals``. ``direct``: sure enough to need no second look; never for comments."""
    part = lambda c: F.nullif(F.coalesce(as_col(c), F.lit("")), F.lit("")) if c is not None else F.lit(None).cast("string")
    text = F.trim(F.concat_ws(" ", part(content), part(thread), part(url)))
    families = patterns or T.LABEL_PATTERNS
    comment = as_col(record_type) == "COMMENT"

    def of(h: Column) -> Column:
        has = lambda n: h[n] > 0
        plain = ~has("seller") & ~has("official")
        relevance = F.when(comment, "high").otherwise("medium")
        label = (
            F.when(has("admin"), _label("community_admin", "other", "low", "low", 0.94, "admin_or_group_rule_markers_detected", "heuristic"))
            .when(has("official") & has("support"), _label("brand_official", "support_answer", "medium", "low", 0.93, "official_support_markers_detected", "heuristic"))
            .when((h["seller"] >= 2) & ~has("question") & ~has("experience"), _label("seller_affiliate", "promotion", "high", "low", 0.92, "promotion_markers_detected", "heuristic"))
            .when(has("experience") & plain, _label("end_user", "experience", "low", "high", 0.9, "experience_markers_detected", "heuristic"))
            .when(has("question") & plain, _label("end_user", "question", "low", relevance, 0.88, "question_markers_detected", "heuristic"))
            .when(has("comparison") & has("experience"), _label("end_user", "comparison", "low", "medium", 0.86, "comparison_and_experience_markers_detected", "heuristic"))
            .otherwise(_label("unknown", "other", "medium", "low", 0.55, "ambiguous_content_needs_ai_review", "hybrid"))
        )

        def finish(x: Column) -> Column:
            shy = _label(x["author_role"], x["content_intent"], x["commerciality_level"], x["user_feedback_relevance"], F.least(x["label_confidence"], F.lit(0.72)), "comment_requires_thread_context", "hybrid")
            signals = F.filter(F.array(*[F.when(h[n] > 0, F.concat(F.lit(f"{n}:"), h[n].cast("string"))) for n in families]), lambda s: s.isNotNull())
            return F.struct(F.when(comment, shy).otherwise(x).alias("label"), (~comment & (x["label_source"] == "heuristic")).alias("direct"), signals.alias("signals"))

        return let(label, finish)

    return let(pattern_hits(text, families), of)


def rule_label(record: Column, text_only: Column | str | None = None, seller=T.RULE_SELLER, official=T.RULE_OFFICIAL, user=T.RULE_USER, asks=T.RULE_ASKS) -> Column:
    """Second-stage label by markers in a whole record (a struct, searched as JSON), or in one text if given.

    In the whole record a question mark in an address makes a question, and a signal's name counts as a marker.
    """
    text = F.lower(as_col(text_only)) if text_only is not None else F.lower(F.to_json(record, {"ignoreNullFields": "false"}))

    def of(x: Column) -> Column:
        return (
            F.when(contains_any(x, seller), _label("seller_affiliate", "promotion", "high", "low", 0.78, "promotion_markers_detected", "ai"))
            .when(contains_any(x, official), _label("brand_official", "support_answer", "medium", "low", 0.78, "official_markers_detected", "ai"))
            .when(contains_any(x, user), _label("end_user", F.when(contains_any(x, asks), "question").otherwise("experience"), "low", "high", 0.78, "end_user_markers_detected", "ai"))
            .otherwise(_label("unknown", "other", "medium", "low", 0.45, "insufficient_context", "ai"))
        )

    return let(text, of)


def coerce_label(label: Column) -> Column:
    """A label brought into the taxonomy: lower case, unknown values to their defaults, confidence within [0, 1] (bad: 0.5)."""
    low = lambda n: F.trim(F.lower(F.coalesce(label[n].cast("string"), F.lit(""))))
    pick = lambda n, allowed, default: F.when(low(n).isin(*allowed), low(n)).otherwise(default)
    number = label["label_confidence"].try_cast("double")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.5))))
    reason = F.substring(F.trim(F.coalesce(label["label_reason"], F.lit(""))), 1, 240)
    return _label(
        pick("author_role", T.AUTHOR_ROLES, "unknown"), pick("content_intent", T.CONTENT_INTENTS, "other"), pick("commerciality_level", T.COMMERCIALITY_LEVELS, "medium"),
        pick("user_feedback_relevance", T.RELEVANCE_LEVELS, "low"), confidence, F.when(reason != "", reason).otherwise("fallback_label_applied"),
        pick("label_source", T.LABEL_SOURCES, "fallback"),
    )


def fallback_label(reason: str = "ai_missing_record_output") -> Column:
    return _label("unknown", "other", "medium", "low", 0.35, reason, "fallback")


def score_in_chunks(records: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 20) -> DataFrame:
    """Rows that an outside ``scorer`` gives for chunks of at most ``size`` records, inside tasks.

    A chunk whose call fails gives no rows and is logged with its fault: left join the result by ``post_id`` and fall back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                try:
                    out = scorer(b.iloc[at : at + size])
                except Exception:  # an outside call; the records get their fallback
                    logging.getLogger("hearken").exception("scoring failed for %d records", len(b.iloc[at : at + size]))
                    continue
                if out is not None and len(out):
                    yield out

    return records.mapInPandas(run, schema)


def label_records(records: DataFrame, scored: DataFrame | None = None, patterns=None, **markers) -> DataFrame:
    """Add ``label`` to records with ``content_masked, content, record_type, source_url`` and thread columns.

    Sure heuristics first; the rest from ``scored`` (``post_id, label``) if given, with a fallback for what it lacks,
    else from :func:`rule_label`.
    """
    content = F.coalesce(F.nullif(F.col("content_masked"), F.lit("")), F.col("content"), F.lit(""))
    r = records.withColumn("_h", heuristic_label(content, "record_type", "thread_context", "source_url", patterns))
    if scored is None:
        whole = F.struct("post_id", "record_type", F.substring(content, 1, 900).alias("content"), "source_url", "parent_post_id", "parent_post_summary", "parent_comment_summary", "thread_context", F.col("_h.signals").alias("signals"), F.col("_h.label").alias("heuristic_prior"))
        second = rule_label(whole, **markers)
    else:
        r = r.join(scored.select("post_id", F.col("label").alias("_s")), "post_id", "left")
        second = F.coalesce("_s", fallback_label())
    return r.withColumn("label", coerce_label(F.when(F.col("_h.direct"), F.col("_h.label")).otherwise(second))).drop("_h", "_s")


def current_labels(history: DataFrame) -> DataFrame:
    """``is_current`` set anew: the newest label of each record, ties to the larger id."""
    w = Window.partitionBy("post_id").orderBy(F.desc("created_at"), F.desc("label_id"))
    return history.withColumn("is_current", F.row_number().over(w) == 1)


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest label job of each run."""
    return jobs.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "run_id"]), F.struct("created_at", "label_job_id")).alias("j")).select("run_id", "j.*")


def label_job_summary(posts: DataFrame, labels: DataFrame, mode: str = "strict") -> DataFrame:
    """One row a run: totals over eligible records, status, and counts by author role (a map). ``labels``: current ones."""
    ok = posts.filter(gates.eligible("judge_decision", "pre_ai_status", mode)).select("run_id", "post_id")
    j = ok.join(labels.select("post_id", "author_role", "label_source"), "post_id", "left")
    by = j.groupBy("run_id", "author_role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_source") == "fallback").alias("f"), F.count("author_role").alias("l"))
    roles = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("author_role").isNotNull(), F.struct("author_role", "n")))))
    out = by.groupBy("run_id").agg(F.sum("n").alias("records_total"), F.sum("l").alias("records_labeled"), F.sum("f").alias("records_fallback"), roles.alias("counts_by_author_role"))
    empty = posts.select("run_id").distinct().join(out, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    failed = F.greatest(F.lit(0), F.coalesce("records_total", F.lit(0)) - F.coalesce("records_labeled", F.lit(0)))
    status = F.when(F.coalesce("records_total", F.lit(0)) == 0, "CANCELLED").when((F.col("records_fallback") > 0) | (failed > 0), "PARTIAL").otherwise("DONE")
    return empty.select("run_id", zero("records_total"), zero("records_labeled"), zero("records_fallback"), failed.alias("records_failed"), status.alias("status"), "counts_by_author_role")


def audit_samples(posts: DataFrame, labels: DataFrame, role: str | None = None, limit: int = 20) -> DataFrame:
    """The first records of each run with a label of ``role``, or those ``excluded`` from end-user answers; 1 to 50 a run."""
    j = posts.join(labels.select(F.col("post_id").alias("_p"), "author_role", "user_feedback_relevance", "label_confidence"), F.col("post_id") == F.col("_p"), "left").drop("_p")
    if role == "excluded":
        j = j.filter(F.col("author_role").isNotNull() & ~((F.col("author_role") == "end_user") & (F.col("user_feedback_relevance") != "low")))
    elif role:
        j = j.filter(F.col("author_role") == role)
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("crawled_at", "post_id"))
    return j.withColumn("rank", n).filter(F.col("rank") <= max(1, min(limit, 50)))
