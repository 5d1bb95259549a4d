"""Relevance scores and rule judgements as columns; one projection gates a table of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.images import has_visual, image_text
from ..functions.text import as_col, clean_payload, contains_any, count_terms, let, normalize_light, normalize_text
from . import gates

PROFILE = "struct<anchors:array<string>,related_terms:array<string>,negative_terms:array<string>>"
JUDGE = "struct<decision:string,relevance_score:double,confidence_score:double,reason_codes:array<string>>"


def lit_profile(anchors=(), related=(), negative=()) -> Column:
    lst = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.struct(lst(anchors).alias("anchors"), lst(related).alias("related_terms"), lst(negative).alias("negative_terms"))


def normalized_profile(profile: Column) -> Column:
    """Terms as comparison keys; compute it once per profile, not per record."""
    keys = lambda n: F.transform(F.coalesce(profile[n], F.array().cast("array<string>")), normalize_text).alias(n)
    return F.struct(*[keys(n) for n in ("anchors", "related_terms", "negative_terms")])


def relevance(content, record_type, source_type, profile: Column, parent_text=None, parent_status=None, cleaned: Column | None = None, found: Column | None = None) -> Column:
    """Struct ``status, score, reason, breakdown, cleaned, quality_flags`` of a record under a normalized profile.

    Totals are rounded to four digits before they are compared; thresholds count as reached. ``cleaned``: what
    :func:`clean_payload` gave, if at hand. ``found``: counts of the profile's terms, if :func:`.termscan.scan_terms` has
    made them over the comparison key of ``cleaned`` (for large lists).
    """
    comment = as_col(record_type) == "COMMENT"
    p_text = normalize_text(F.coalesce(as_col(parent_text), F.lit(""))) if parent_text is not None else F.lit("")
    p_status = as_col(parent_status) if parent_status is not None else F.lit(None).cast("string")
    hits = lambda key, n: count_terms(key, profile[n]) if found is None else found[n]
    num = lambda c, x: F.when(c, x).otherwise(0.0)

    def scored(x: Column) -> Column:
        key, flags = x["key"], x["flags"]
        short, noise = F.array_contains(flags, "too_short"), F.array_contains(flags, "ui_noise_removed")
        near = F.exists(F.slice(profile["anchors"], 1, 3), lambda t: (t != "") & F.contains(p_text, t))
        parts = F.struct(
            F.least(x["anchors"] * 0.22, F.lit(0.44)).alias("anchor_score"),
            F.least(x["related"] * 0.06, F.lit(0.24)).alias("related_score"),
            (num(F.length(key) >= 24, 0.10) + num(F.length(key) >= 80, 0.08) - num(short, 0.08) - num(noise, 0.02)).alias("quality_score"),
            F.when(as_col(source_type).isin("SEARCH_IN_GROUP", "CRAWL_FEED"), 0.06).otherwise(0.03).alias("source_score"),
            F.when(comment, num(p_status == "ACCEPTED", 0.18) + num(p_text != "", 0.06) + num((p_text != "") & near, 0.06)).otherwise(0.0).alias("parent_context_score"),
            F.least(x["negative"] * 0.18, F.lit(0.54)).alias("negative_penalty"),
        )
        return let(parts, lambda b: decided(x, b, short))

    def decided(x: Column, b: Column, short: Column) -> Column:
        total = F.round(b["anchor_score"] + b["related_score"] + b["quality_score"] + b["source_score"] + b["parent_context_score"] - b["negative_penalty"], 4)

        def status(t: Column) -> Column:
            high, low = F.when(comment, 0.36).otherwise(0.48), F.when(comment, 0.20).otherwise(0.30)
            held_back = (b["negative_penalty"] >= 0.36) | short
            lifted = comment & (b["parent_context_score"] >= 0.18)
            what = F.when(t >= high, F.when(held_back, "UNCERTAIN").otherwise("ACCEPTED")).when((t >= low) | lifted, "UNCERTAIN").otherwise("REJECTED")
            some = lambda n, name: F.when(x[n] > 0, F.concat(F.lit(f"{name}="), x[n].cast("string")))
            why = F.concat_ws(
                ", ", some("anchors", "anchor_hits"), some("related", "related_hits"), some("negative", "negative_hits"),
                F.when(comment & (b["parent_context_score"] > 0), "parent_context"),
            )
            rounded = F.struct(*[F.round(b[n], 4).alias(n) for n in ("anchor_score", "related_score", "quality_score", "source_score", "parent_context_score", "negative_penalty")])
            return F.struct(
                what.alias("status"), F.greatest(t, F.lit(0.0)).alias("score"), F.when(why != "", why).otherwise("weak_signal").alias("reason"),
                rounded.alias("breakdown"), x["cleaned"].alias("cleaned"), x["flags"].alias("quality_flags"),
            )

        return let(total, status)

    def with_key(c: Column) -> Column:
        return let(
            normalize_text(c["cleaned"]),
            lambda key: let(
                F.struct(key.alias("key"), c["cleaned"].alias("cleaned"), c["quality_flags"].alias("flags"), hits(key, "anchors").alias("anchors"), hits(key, "related_terms").alias("related"), hits(key, "negative_terms").alias("negative")),
                scored,
            ),
        )

    return with_key(cleaned) if cleaned is not None else let(clean_payload(content), with_key)


def _judge(decision, rel, conf, *codes) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(rel).alias("relevance_score"), F.lit(conf).alias("confidence_score"), F.array(*map(F.lit, codes)).alias("reason_codes"))


def rule_judge(content, record_type, image_summary=None, markers: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Struct of a judgement by rules, first that fits: commercial, experience or comparison, a comment's question, image text."""
    m = {
        "transactional": T.JUDGE_TRANSACTIONAL, "promotional": T.JUDGE_PROMOTIONAL, "experience": T.JUDGE_EXPERIENCE,
        "comparison": T.JUDGE_COMPARISON, "question": T.JUDGE_QUESTION,
    } | (markers or {})
    raw = F.coalesce(as_col(content), F.lit(""))
    picture = normalize_light(F.coalesce(as_col(image_summary), F.lit(""))) if image_summary is not None else F.lit("")

    def of(x: Column) -> Column:
        has = lambda n: contains_any(x, m[n])
        asks = raw.contains("?") | has("question")
        return (
            F.when(has("promotional") | has("transactional"), _judge("REJECTED", 0.08, 0.9, "commercial_noise"))
            .when(has("experience") | has("comparison"), _judge("ACCEPTED", 0.86, 0.82, "experience_signal", "non_commercial"))
            .when((F.upper(as_col(record_type)) == "COMMENT") & asks, _judge("UNCERTAIN", 0.48, 0.62, "comment_depends_on_thread"))
            .when(picture != "", _judge("ACCEPTED", 0.74, 0.72, "visual_signal_present"))
            .otherwise(_judge("UNCERTAIN", 0.42, 0.58, "mixed_signal"))
        )

    return let(normalize_light(raw), of)


def clamp(c: Column | str) -> Column:
    """A number within [0, 1]; what is no number counts as 0."""
    x = as_col(c).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))))


def normalize_judge(decision, rel, conf, reasons: Column, spec_id: Column, content_id: Column) -> Column:
    """A judgement from outside brought into bounds; an unknown decision is taken from the relevance."""

    def of(x: Column) -> Column:
        d = F.when(x["d"].isin("ACCEPTED", "REJECTED", "UNCERTAIN"), x["d"]).when(x["r"] >= 0.65, "ACCEPTED").when(x["r"] <= 0.25, "REJECTED").otherwise("UNCERTAIN")
        codes = F.coalesce(reasons, F.array().cast("array<string>"))
        trimmed = F.filter(F.transform(codes, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
        return F.struct(
            d.alias("decision"), x["r"].alias("relevance_score"), x["c"].alias("confidence_score"),
            F.when(F.size(codes) > 0, trimmed).otherwise(F.array(F.concat(F.lit("decision_"), F.lower(d)))).alias("reason_codes"),
            F.concat(F.coalesce(spec_id, F.lit("spec-fallback")), F.lit(":"), content_id).alias("cache_key"),
        )

    return let(F.struct(F.trim(F.upper(F.coalesce(as_col(decision), F.lit("")))).alias("d"), clamp(rel).alias("r"), clamp(conf).alias("c")), of)


def fallback_judge(score: Column, prefix: str = "model_judge_fallback") -> Column:
    """A judgement from a record's relevance."""
    conf = F.when(score["status"] == "ACCEPTED", 0.85).when(score["status"] == "UNCERTAIN", 0.55).otherwise(0.9)
    return F.struct(score["status"].alias("decision"), score["score"].alias("relevance_score"), conf.alias("confidence_score"), F.array(F.lit(prefix), score["reason"]).alias("reason_codes"))


def hard_reject(reason: Column) -> Column:
    return F.struct(F.lit("REJECTED").alias("decision"), F.lit(0.0).alias("relevance_score"), F.lit(0.99).alias("confidence_score"), F.array(reason).alias("reason_codes"))


def gate_records(records: DataFrame, judged: str | None = None, **markers) -> DataFrame:
    """One row per record with its judgement and what follows from it.

    ``records``: ``content, record_type, source_type, query_family, source_group_name, source_url, parent_text, parent_status,
    profile`` (as :func:`normalized_profile`), ``spec``; image columns if there are any. ``judged`` names a column with a
    judgement from outside (null: it failed, the relevance decides); without one the rules judge.
    """
    cols = set(records.columns)
    pick = lambda n: F.col(n) if n in cols else F.lit(None).cast("string")
    r = records.withColumn("_clean", clean_payload("content"))
    spec = F.col("spec")
    r = r.withColumns(
        {
            "_source": gates.source_prefilter(spec, "source_group_name", "source_url", F.col("profile.anchors"), "query_family"),
            "_hard": gates.hard_filter("content", "record_type", spec["comment_policy"], cleaned=F.col("_clean.cleaned")),
            "score": relevance("content", "record_type", "source_type", F.col("profile"), "parent_text", "parent_status", cleaned=F.col("_clean")),
        }
    )
    if judged:
        verdict = F.coalesce(F.col(judged), fallback_judge(F.col("score")))
    else:
        urls = F.col("image_urls") if "image_urls" in cols else F.array().cast("array<string>")
        seen = image_text(pick("image_summary"), pick("image_alt_text"), pick("image_ocr_text"))
        first = rule_judge(F.col("_clean.cleaned"), "record_type", markers=markers or None)
        if cols & {"image_urls", "image_summary", "image_alt_text", "image_ocr_text"}:
            again = rule_judge(F.col("_clean.cleaned"), "record_type", seen, markers=markers or None)
            visual = gates.wants_image_text("content", first["decision"], urls, pick("image_alt_text"), pick("image_summary"), pick("image_ocr_text"), spec["target_signal_types"])
            verdict = F.when(visual & (seen != ""), again).otherwise(first)
        else:
            verdict = first
    judge = F.when(F.col("_source").isNotNull(), hard_reject(F.col("_source"))).when(F.col("_hard").isNotNull(), hard_reject(F.col("_hard"))).otherwise(verdict)
    r = r.withColumn("judge", judge)
    out = F.col("judge.decision") == "REJECTED"
    return r.withColumns(
        {
            "content_masked": F.col("_clean.cleaned"),
            "quality_flags": F.when(F.col("_source") == "source_prefilter_broker_group", F.array(F.lit("source_prefilter"), F.lit("broker_group_source")))
            .when(F.col("_source").isNotNull(), F.array(F.lit("source_prefilter"), F.lit("official_brand_page_source")))
            .otherwise(F.col("_clean.quality_flags")),
            "processing_stage": F.when(out, "SCORED_REJECTED").otherwise("CLEAN_ACCEPTED"),
            "is_excluded": out,
            "exclude_reason": F.when(out, F.array_join("judge.reason_codes", ";")),
        }
    ).drop("_clean", "_source", "_hard")


__all__ = ["clamp", "fallback_judge", "gate_records", "hard_reject", "has_visual", "lit_profile", "normalize_judge", "normalized_profile", "relevance", "rule_judge"]
