"""Topic profiles and the queries made from them: columns over arrays, one row per context or query."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import terms as T
from ..functions.text import as_col, collapse, contains_any, dedupe_ci, dedupe_keep_order, let, normalize_text, slugify

FAMILY = "struct<intent:string,query:string>"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _join(*parts: Column | str) -> Column:
    return F.trim(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _terms(keywords: Column, name: str) -> Column:
    return dedupe_keep_order(F.coalesce(F.try_element_at(keywords, F.lit(name)), F.array().cast("array<string>")))


def _families(intent: str, queries: Column) -> Column:
    return F.transform(queries, lambda q: F.struct(F.lit(intent).alias("intent"), q.alias("query")))


def select_anchor(reference: Column | str, anchors: Column) -> Column:
    """The anchor nearest to a text: equal, containing it, most shared words, several words, most words; ties to the first."""
    ref = F.trim(as_col(reference))

    def pick(key: Column) -> Column:
        def score(a: Column, i: Column) -> Column:
            return let(
                normalize_text(a),
                lambda k: F.struct(
                    (k == key).cast("int").alias("equal"),
                    ((key != "") & F.contains(k, key)).cast("int").alias("holds"),
                    F.size(F.array_intersect(_words(k), _words(key))).alias("shared"),
                    (F.size(_words(k)) > 1).cast("int").alias("several"),
                    F.size(_words(k)).alias("n"),
                    (-i).alias("place"),
                    a.alias("anchor"),
                ),
            )

        return F.array_max(F.transform(dedupe_keep_order(anchors), score))["anchor"]

    best = let(normalize_text(ref), pick)
    return F.coalesce(F.nullif(F.trim(best), F.lit("")), ref)


def bears_images(c: Column | str) -> Column:
    return contains_any(normalize_text(c), T.IMAGE_TERMS)


def build_profile(contexts: DataFrame, promo: tuple[str, ...] = T.PROMO_TERMS) -> DataFrame:
    """Add ``profile`` to contexts with ``topic`` and ``keywords`` (map of lists of words by kind)."""
    kw = F.col("keywords")
    named = contexts.withColumns({f"_{k}": _terms(kw, k) for k in ("brand", "pain_points", "behavior", "comparison", "sentiment")})
    anchors = dedupe_keep_order(F.concat("_brand", F.array("topic")))
    named = named.withColumn("_anchors", anchors)
    named = named.withColumn("_base", F.when(F.size("_anchors") > 0, select_anchor("topic", F.col("_anchors"))).otherwise(F.col("topic")))
    base = F.col("_base")
    made = lambda intent, *texts: F.array(*[F.struct(F.lit(intent).alias("intent"), t.alias("query")) for t in texts])
    pictures = F.concat(made("image_review", _join(base, " review co hinh anh")), made("before_after", _join(base, " truoc va sau")))
    families = F.concat(
        made("brand", base),
        _families("pain_point", F.slice("_pain_points", 1, 2)),
        made("question", *[_join(base, f" {s}") for s in T.QUESTION_SUFFIXES[:2]]),
        _families("comparison", F.slice("_comparison", 1, 2)),
        made("complaint", *[_join(f"{p} ", base) for p in T.COMPLAINT_PREFIXES[:2]]),
        F.when(bears_images("topic"), pictures).otherwise(F.array().cast(f"array<{FAMILY}>")),
    )
    profile = F.struct(
        F.slice("_anchors", 1, 8).alias("anchors"),
        F.slice(dedupe_keep_order(F.concat("_pain_points", "_behavior", "_comparison", "_sentiment")), 1, 16).alias("related_terms"),
        F.array(*map(F.lit, sorted(promo)[:16])).alias("negative_terms"),
        F.slice(families, 1, 8).alias("query_families"),
        F.slice(dedupe_keep_order(F.concat(F.slice("_brand", 1, 3), F.slice("_pain_points", 1, 2))), 1, 5).alias("source_hints"),
    )
    return named.withColumn("profile", profile).select(*contexts.columns, "profile")


def infer_query_family(query: Column | str, profile: Column) -> Column:
    """Intent of the first family whose query contains, or is contained in, the query; else question or generic."""
    q = as_col(query)

    def find(key: Column) -> Column:
        near = lambda f: let(normalize_text(F.coalesce(f["query"], F.lit(""))), lambda k: (k != "") & (F.contains(key, k) | F.contains(k, key)))
        family = F.try_element_at(F.filter(profile["query_families"], near), F.lit(1))
        return F.when(family.isNotNull(), F.coalesce(F.nullif(family["intent"], F.lit("")), F.lit("generic")))

    asks = q.contains("?") | F.lower(q).contains("co ")
    return F.when(profile.isNull(), "generic").otherwise(F.coalesce(let(normalize_text(q), find), F.when(asks, "question").otherwise("generic")))


def signal_text(spec: Column) -> Column:
    """What a validity spec looks for, as one comparison key."""
    some = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    return normalize_text(F.concat_ws(" ", F.coalesce(spec["research_objective"], F.lit("")), some(spec["target_signal_types"]), some(spec["must_have_signals"])))


def _incomplete(key: Column) -> Column:
    return key.endswith(" vs") | key.contains(" vs ")


def preferred_intents(query: Column, profile: Column, signals: Column) -> Column:
    """Intents in the order in which a query's variants are tried."""
    key = normalize_text(query)
    order = lambda *x: F.array(*map(F.lit, x))
    family = infer_query_family(query, profile)
    return (
        F.when(bears_images(F.concat_ws(" ", query, signals)), order("image_review", "before_after", "pain_point", "question", "comparison", "complaint", "brand"))
        .when(_incomplete(key), order("comparison", "pain_point", "question", "complaint"))
        .when(contains_any(key, T.COMPLAINT_TERMS), order("complaint", "pain_point", "question", "comparison"))
        .when(contains_any(signals, T.TRUST_TERMS + T.COST_TERMS), order("complaint", "pain_point", "question", "comparison", "brand"))
        .when(contains_any(signals, T.SYMPTOM_TERMS), order("pain_point", "question", "comparison", "complaint", "brand"))
        .when(family.isin("generic", "brand"), order("pain_point", "question", "comparison", "complaint"))
        .when(family == "comparison", order("comparison", "pain_point", "question", "complaint"))
        .otherwise(order("question", "pain_point", "comparison", "complaint"))
    )


def base_query(query: Column, profile: Column) -> Column:
    anchors = F.coalesce(profile["anchors"], F.array().cast("array<string>"))
    return F.when(F.size(anchors) > 0, select_anchor(query, anchors)).otherwise(F.trim(query))


def _when(cond: Column, *texts: Column) -> Column:
    return F.when(cond, F.array(*texts)).otherwise(F.array().cast("array<string>"))


def _without(values: Column, query: Column) -> Column:
    return let(normalize_text(query), lambda k: F.filter(values, lambda v: normalize_text(v) != k))


def semantic_expansions(query: Column, profile: Column, signals: Column) -> Column:
    def of(base: Column) -> Column:
        related = F.transform(F.slice(F.coalesce(profile["related_terms"], F.array().cast("array<string>")), 1, 2), lambda t: _join(base, " ", t))
        trust, cost = contains_any(signals, T.TRUST_TERMS), contains_any(signals, T.COST_TERMS)
        return F.concat(
            _when(bears_images(F.concat_ws(" ", query, signals)), _join(base, " review co hinh anh"), _join(base, " truoc va sau"), _join(base, " screenshot")),
            _when(trust, _join(base, " bi lua")),
            _when(cost, _join(base, " phi cao"), _join(base, " lai suat cao")),
            _when(trust, _join(base, " review"), _join(base, " co uy tin khong")),
            related,
        )

    return _without(dedupe_keep_order(let(base_query(query, profile), of)), query)


def suggest_queries(query: Column | str, profile: Column, spec: Column, most: int | Column = 2) -> Column:
    """The query and its variants, best first, at most ``most``."""
    q = as_col(query)
    signals = signal_text(spec)
    families = F.coalesce(profile["query_families"], F.array().cast(f"array<{FAMILY}>"))
    unfinished = _incomplete(normalize_text(q))
    of = lambda intent: F.transform(F.filter(families, lambda f: (f["intent"] == intent) & (F.trim(f["query"]) != "")), lambda f: F.trim(f["query"]))
    by_intent = F.flatten(F.transform(preferred_intents(q, profile, signals), lambda intent, i: F.when(unfinished & (i == 0), F.concat(of(intent), F.array(q))).otherwise(of(intent))))
    lead = F.when(unfinished, F.array().cast("array<string>")).otherwise(F.concat(F.array(q), semantic_expansions(q, profile, signals)))
    n = most if isinstance(most, Column) else F.lit(max(1, most))
    return F.slice(dedupe_keep_order(F.concat(lead, by_intent, F.array(q))), F.lit(1), n)


def build_reformulations(query: Column | str, profile: Column, spec: Column, cluster: Column | str, most: int = 2) -> Column:
    """Rewrites of a query whose results were rejected for reasons of ``cluster``; never the query itself."""
    q, c = as_col(query), as_col(cluster)

    def of(base: Column) -> Column:
        related = F.transform(F.slice(F.coalesce(profile["related_terms"], F.array().cast("array<string>")), 1, 2), lambda t: _join(base, " ", t))
        return (
            F.when(c == "promo_noise", F.array(_join(base, " bi lua"), _join(base, " co uy tin khong"), _join("review ", base)))
            .when(c == "trust_gap", F.array(_join(base, " bi lua"), _join(base, " co uy tin khong")))
            .when(c == "cost_gap", F.array(_join(base, " phi cao"), _join(base, " lai suat cao")))
            .when(c == "symptom_gap", related)
            .when(c == "target_weak", F.array(base, _join("review ", base)))
            .otherwise(F.array().cast("array<string>"))
        )

    more = suggest_queries(q, profile, spec, max(most + 1, 3))
    return F.slice(_without(dedupe_keep_order(F.concat(let(base_query(q, profile), of), more)), q), 1, most)


def reason_cluster(reason: Column | str) -> Column:
    """Cluster of one reason code; the first that fits."""
    k = normalize_text(reason)
    return (
        F.when(contains_any(k, T.PROMO_REASONS), "promo_noise")
        .when(contains_any(k, T.TARGET_REASONS), "target_weak")
        .when(contains_any(k, T.COST_TERMS), "cost_gap")
        .when(contains_any(k, T.TRUST_TERMS), "trust_gap")
        .when(contains_any(k, T.SYMPTOM_TERMS), "symptom_gap")
        .otherwise("generic_weak")
    )


def cluster_reject_reasons(reasons: DataFrame, paths: DataFrame, key: str = "path_id") -> DataFrame:
    """``key, reason_cluster``: the most common cluster of each path's reason codes, ties to the one counted first.

    ``reasons`` has ``key, reason, ordinal``; ``paths`` has ``key, query, signals`` (:func:`signal_text`). What the spec
    asks for and the query doesn't mention counts once more. A path without any reason and bonus is ``generic_weak``.
    """
    late = 1 << 62
    counted = reasons.groupBy(key, reason_cluster("reason").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("at"))
    q = normalize_text("query")
    bonus = F.array(
        *[
            F.when(contains_any(F.col("signals"), words) & ~contains_any(q, words), F.struct(F.lit(name).alias("cluster"), F.lit(1).cast("long").alias("n"), F.lit(late + i).alias("at")))
            for i, (name, words) in enumerate((("trust_gap", T.TRUST_TERMS), ("cost_gap", T.COST_TERMS), ("symptom_gap", T.SYMPTOM_TERMS)))
        ]
    )
    extra = paths.select(key, F.explode(F.filter(bonus, lambda b: b.isNotNull())).alias("b")).select(key, "b.*")
    total = counted.select(key, "cluster", "n", F.col("at").cast("long")).unionByName(extra).groupBy(key, "cluster").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    best = total.groupBy(key).agg(F.max_by("cluster", F.struct("n", -F.col("at"))).alias("reason_cluster"))
    return paths.select(key).join(best, key, "left").select(key, F.coalesce("reason_cluster", F.lit("generic_weak")).alias("reason_cluster"))


def split_search_candidates(value: Column | str) -> Column:
    """Pieces of a free search target: no group prefix, no parentheses, cut at separators, lower-case duplicates gone."""
    x = collapse(F.coalesce(as_col(value), F.lit("")))
    head = F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))), " ", "_")
    x = F.when(x.contains(":") & head.isin(*T.KEYWORD_GROUPS), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))).otherwise(x)
    x = F.regexp_replace(x, r"\((.*?)\)", " ")
    clean = lambda p: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.trim(p), r"(?i)^(brand|pain[_ ]points|sentiment|behavior|comparison|keywords?)\s*:?\s*", ""), r"\s+", " "), r"^[ -]+|[ -]+$", ""
    )
    parts = F.filter(F.transform(F.split(x, r"[,;|\n/]+"), clean), lambda p: p != "")
    return dedupe_ci(F.when(F.size(parts) > 0, parts).when(x != "", F.array(x)).otherwise(F.array().cast("array<string>")))


def is_valid_search_query(c: Column) -> Column:
    low = F.trim(F.lower(c))
    return (low != "") & ~contains_any(low, T.PLACEHOLDERS) & (F.size(_words(collapse(low))) <= 5) & ~low.isin(*T.KEYWORD_GROUPS, "pain points")


def search_query_score(c: Column) -> Column:
    n = F.size(_words(collapse(c)))
    return F.struct((n >= 2).cast("int").alias("specific"), F.least(n, F.lit(5)).alias("words"), F.length(F.lower(c)).alias("chars"))


def pick_search_query(value: Column | str, fallback: Column | str) -> Column:
    """The best valid piece of a target; else the first five words of its first piece, of ``fallback``, or ``research``."""

    def pick(parts: Column) -> Column:
        valid = F.transform(parts, lambda p, i: F.struct(search_query_score(p).alias("s"), (-i).alias("place"), p.alias("q")))
        best = F.array_max(F.filter(valid, lambda v: is_valid_search_query(v["q"])))["q"]
        first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.nullif(as_col(fallback), F.lit("")), F.lit("research"))
        cut = F.array_join(F.slice(_words(collapse(first)), 1, 5), " ")
        return F.coalesce(best, F.when(cut != "", cut).otherwise("research"))

    return let(split_search_candidates(value), pick)


def related_keywords(target: Column | str, keywords: Column) -> Column:
    """Keywords that share words with a target: most shared, then best score; at most five."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))
    flat = F.flatten(F.map_values(keywords))

    def rank(own: Column) -> Column:
        scored = F.transform(flat, lambda k, i: F.struct(F.size(F.array_intersect(tokens(k), own)).alias("n"), search_query_score(k).alias("s"), (-i).alias("place"), k.alias("k")))
        best = F.reverse(F.array_sort(F.filter(scored, lambda x: x["n"] > 0)))
        return dedupe_ci(F.transform(F.slice(best, 1, 5), lambda x: x["k"]))

    return let(tokens(as_col(target)), rank)


def resolve_search_query(target: Column | str) -> Column:
    """The query inside a plan step's target."""
    t = F.coalesce(as_col(target), F.lit(""))
    named = F.regexp_extract(t, r"(?i)^keyword:\s*(.+?)\s+in\s+groups?\s+from\s+step-", 1)
    head = lambda c: F.trim(F.regexp_extract(c, r"(?s)^(.*?)(?: in |$)", 1))
    after = head(F.trim(F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)))
    return F.when(named != "", F.trim(named)).when(t.contains(":"), after).otherwise(F.coalesce(F.nullif(head(t), F.lit("")), F.lit("research")))


LISTS = ("target_signal_types", "target_author_types", "non_target_author_types", "must_have_signals", "nice_to_have_signals", "hard_reject_signals", "valid_examples", "invalid_examples")


def normalize_validity_spec(specs: DataFrame, topic: str = "topic", spec: str = "spec", fallback: str = "fallback", **contract: Column) -> DataFrame:
    """Replace ``spec`` by its normalized form: missing or empty fields from ``fallback``, lists without duplicates, ratios
    within [0, 1], counts at least 0 or 1; examples at most five. ``spec_version`` is the digest of the contract as it came
    in: topic, objective, signals, and what else is given of ``clarification_history`` (array), ``keywords``,
    ``retrieval_profile`` (maps or structs) and ``plan_intent`` (text); what is missing counts as empty."""
    s, f = F.col(spec), F.col(fallback)
    fields = set(specs.schema[spec].dataType.fieldNames())
    lists = []
    for name in LISTS:
        if name in fields:
            own = dedupe_keep_order(F.when(F.size(s[name]) > 0, s[name]).otherwise(f[name]))
            lists.append((F.slice(own, 1, 5) if name.endswith("_examples") else own).alias(name))
    unit = lambda g, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s[g][n], f[g][n]).cast("double"))).alias(n)
    objective = F.trim(F.coalesce(F.nullif(s["research_objective"], F.lit("")), f["research_objective"])).alias("research_objective")
    comment = F.struct(
        F.coalesce(s["comment_policy"]["allow_parent_context"], F.lit(True)).alias("allow_parent_context"),
        F.coalesce(s["comment_policy"]["reject_transactional_only_comments"], f["comment_policy"]["reject_transactional_only_comments"], F.lit(True)).alias("reject_transactional_only_comments"),
        F.greatest(F.lit(0), F.coalesce(s["comment_policy"]["minimum_comment_text_length"], f["comment_policy"]["minimum_comment_text_length"], F.lit(8))).alias("minimum_comment_text_length"),
    ).alias("comment_policy")
    batch = F.struct(
        unit("batch_policy", "min_accept_ratio"),
        unit("batch_policy", "min_high_conf_accept_ratio"),
        F.greatest(F.lit(1), F.coalesce(s["batch_policy"]["max_consecutive_weak_batches"], f["batch_policy"]["max_consecutive_weak_batches"])).alias("max_consecutive_weak_batches"),
        unit("batch_policy", "uncertain_reformulation_floor"),
    ).alias("batch_policy")
    nothing = {"clarification_history": F.array().cast("array<string>"), "keywords": F.create_map().cast("map<string,string>"), "retrieval_profile": F.create_map().cast("map<string,string>"), "plan_intent": F.lit("")}
    unknown = set(contract) - set(nothing)
    if unknown:
        raise TypeError(f"no part of a contract: {sorted(unknown)}")
    parts = {n: F.to_json(e) if n not in contract else F.coalesce(F.to_json(contract[n]), F.to_json(e)) for n, e in nothing.items() if n != "plan_intent"}
    intent = F.coalesce(contract.get("plan_intent", F.lit("")), F.lit("")).alias("plan_intent")
    raw = [F.coalesce(s[n], f[n]).alias(n) for n in ("research_objective", "target_signal_types", "must_have_signals", "hard_reject_signals") if n in fields]
    flat = F.to_json(F.struct(F.col(topic).alias("topic"), intent, *raw), {"ignoreNullFields": "false"})
    nested = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), c) for n, c in parts.items()])
    version = contract_hash(F.concat(F.lit("{"), nested, F.lit(","), F.substring(flat, 2, 2**31 - 1)))
    out = F.struct(
        F.concat(F.lit("spec-"), slugify(topic), F.lit("-"), version).alias("spec_id"), F.concat(F.lit("phase8-v1-"), version).alias("spec_version"), objective, *lists, comment, batch
    )
    return specs.withColumn(spec, out)


@F.pandas_udf(StringType())
def contract_hash(contract: pd.Series) -> pd.Series:
    """First ten hex digits of the SHA-256 of a JSON document with sorted keys, spaces after separators, as Python prints it."""
    text = contract.map(lambda x: json.dumps(json.loads(x or "{}"), ensure_ascii=False, sort_keys=True))
    return text.map(lambda x: hashlib.sha256(x.encode()).hexdigest()[:10])


def with_arrival(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """``ordinal`` within each ``key``, from 1."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def contexts_of_runs(runs: DataFrame, plans: DataFrame, contexts: DataFrame) -> DataFrame:
    """Runs with their plan's context: ``run_id, topic, profile, spec``. Missing plans, contexts and broken JSON give nulls.

    ``contexts`` holds its profile and spec as JSON text; both are parsed once a context, before the joins.
    """
    from ..sources.tables import lenient_json

    c = contexts.select(
        "context_id",
        "topic",
        lenient_json(PROFILE_JSON, "retrieval_profile_json").alias("profile"),
        lenient_json(SPEC_JSON, "validity_spec_json").alias("spec"),
    )
    return runs.join(plans.select("plan_id", "context_id"), "plan_id", "left").join(c, "context_id", "left").select(*runs.columns, "topic", "profile", "spec")


PROFILE_JSON = f"anchors array<string>, related_terms array<string>, negative_terms array<string>, query_families array<{FAMILY}>, source_hints array<string>"
SPEC_JSON = (
    "spec_id string, spec_version string, research_objective string, target_signal_types array<string>, target_author_types array<string>, non_target_author_types array<string>, must_have_signals array<string>, "
    "nice_to_have_signals array<string>, hard_reject_signals array<string>, valid_examples array<string>, invalid_examples array<string>, "
    "comment_policy struct<allow_parent_context:boolean,reject_transactional_only_comments:boolean,minimum_comment_text_length:int>, "
    "batch_policy struct<min_accept_ratio:double,min_high_conf_accept_ratio:double,max_consecutive_weak_batches:int,uncertain_reformulation_floor:double>"
)
