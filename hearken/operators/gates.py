"""Record gates: predicates and reasons as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.images import has_visual
from ..functions.text import as_col, clean_payload, contains_any, count_terms, let, normalize_text


def _key_of(c: Column | str) -> Column:
    return normalize_text(F.coalesce(as_col(c), F.lit("")))


def source_filter_enabled(spec: Column, triggers: tuple[str, ...] = T.SOURCE_FILTER_TRIGGERS) -> Column:
    """Whether a spec asks for organic sources."""
    lists = [F.coalesce(F.array_join(spec[n], " "), F.lit("")) for n in ("target_author_types", "non_target_author_types", "hard_reject_signals", "target_signal_types")]
    return contains_any(normalize_text(F.concat_ws(" ", *lists, F.coalesce(spec["research_objective"], F.lit("")))), triggers)


def broker_group(name: Column | str, broker=T.BROKER_TERMS, discussion=T.DISCUSSION_TERMS, lead=T.LEAD_TERMS) -> Column:
    """Whether a group's name reads like a broker's: two of their terms; one and a phone number; or one, a lead and no discussion."""
    raw = F.coalesce(as_col(name), F.lit(""))

    def of(key: Column) -> Column:
        n = count_terms(key, broker)
        lead_gen = (count_terms(key, discussion) == 0) & contains_any(key, lead)
        return (key != "") & ((n >= 2) | ((n >= 1) & (raw.rlike(r"\d{7,}") | lead_gen)))

    return let(normalize_text(raw), of)


def official_brand_page(url: Column | str, anchors: Column, family: Column | str) -> Column:
    """Whether a brand query's result is a post on a page named after an anchor of four or more letters."""
    u = F.coalesce(F.trim(as_col(url)), F.lit(""))
    low = F.lower(u)
    part = lambda p: _key_of(F.regexp_replace(F.regexp_extract(u, p, 1), "/", " "))
    host, path = part(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"), part(r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)")
    page = contains_any(low, ("/posts/", "/videos/", "/photos/")) & ~low.contains("/groups/")
    named = let(
        F.struct(host.alias("h"), path.alias("p")),
        lambda x: F.exists(
            F.transform(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: normalize_text(F.coalesce(a, F.lit("")))),
            lambda a: (F.length(a) >= 4) & (F.contains(x["p"], a) | F.contains(x["h"], a)),
        ),
    )
    return (as_col(family) == "brand") & page & named


def source_prefilter(spec: Column, group_name: Column | str, url: Column | str, anchors: Column, family: Column | str) -> Column:
    """Reason why a record's source rules it out, else null."""
    return F.when(
        source_filter_enabled(spec),
        F.when(broker_group(group_name), "source_prefilter_broker_group").when(official_brand_page(url, anchors, family), "source_prefilter_official_brand_page"),
    )


def hard_filter(content: Column | str, record_type: Column | str, policy: Column, transactional=T.TRANSACTIONAL_TERMS, cleaned: Column | None = None) -> Column:
    """Reason why a record is out before any scoring, else null. ``policy``: struct of the comment policy, may be null."""
    text = cleaned if cleaned is not None else clean_payload(content)["cleaned"]
    shortest = F.coalesce(policy["minimum_comment_text_length"], F.lit(0))
    strict = F.coalesce(policy["reject_transactional_only_comments"], F.lit(False))
    comment = F.upper(as_col(record_type)) == "COMMENT"

    def of(key: Column) -> Column:
        deal = contains_any(key, transactional) & (F.size(F.split(key, " ")) <= 8)
        return (
            F.when(key == "", "empty_content")
            .when(key.isin(*T.SEVERE_UI_NOISE), "ui_noise_only")
            .when(comment & (shortest > 0) & (F.length(key) < shortest), "comment_too_short")
            .when(comment & strict & deal, "transactional_only_comment")
        )

    return let(normalize_text(text), of)


def gate_status(judge: Column | str, pre: Column | str) -> Column:
    """Judge's decision, else the earlier status, upper case; empty counts as none."""
    return F.upper(F.coalesce(F.nullif(as_col(judge), F.lit("")), F.nullif(as_col(pre), F.lit(""))))


def eligible(judge: Column | str, pre: Column | str, mode: str = "strict") -> Column:
    """Whether a record goes on to labels and themes; undecided ones only in ``balanced`` mode, those without a status always."""
    s = gate_status(judge, pre)
    return s.isNull() | s.isin(*(("ACCEPTED", "UNCERTAIN") if mode.lower() == "balanced" else ("ACCEPTED",)))


def audience_reason(role: Column | str, relevance: Column | str, confidence: Column | str, audience: str = "end_user_only") -> Column:
    """Why a labelled record is not for the audience, else null. A null role means no label. Unknown audiences are an error."""
    audience = (audience or "end_user_only").strip().lower()
    if audience not in T.AUDIENCES:
        raise ValueError(f"unsupported audience {audience!r}")
    r, c = as_col(role), as_col(confidence)
    base = F.when(r.isNull(), "missing_label").when(as_col(relevance) == "low", "low_relevance")
    if audience == "end_user_only":
        return base.when(r != "end_user", r).when(c < 0.45, "low_confidence")
    if audience == "include_seller":
        return base.when(r.isin("brand_official", "community_admin"), r).when((r == "unknown") & (c < 0.6), "low_confidence")
    return base.when(r == "community_admin", "community_admin")


def wants_image_text(content: Column | str, decision: Column | str, urls, alt, summary, ocr, signal_types: Column) -> Column:
    """Whether text found in images should join the judgement."""
    visual = F.exists(F.coalesce(signal_types, F.array().cast("array<string>")), lambda s: contains_any(normalize_text(s), ("visual", "image")))
    return has_visual(urls, alt, summary, ocr) & ((as_col(decision) == "UNCERTAIN") | (F.length(_key_of(content)) < 24) | visual)
