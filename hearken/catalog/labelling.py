"""Queries of threads, labels and audiences."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import gates, groups, labels, themes, threads
from ..plans import jobs
from ..sources import upsert
from ..views import candidates, judged, label_history, posts, table, with_views
from .gating import any_of
from .streams import shared
from .text import collapse

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_views("posts") + " SELECT c.post_id, p.content AS parent_text, CASE WHEN p.post_id IS NOT NULL THEN 'ACCEPTED' END AS parent_status FROM posts c LEFT JOIN posts p ON p.run_id = c.run_id AND p.post_id = c.parent_post_id WHERE c.record_type = 'COMMENT'")
def jn_parent_context(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = posts(spark, d).withColumns({"judge_decision": none, "pre_ai_status": F.lit(""), "source_url": none, "parent_post_url": none})
    return threads.parent_context(p.filter("record_type = 'COMMENT'"), p).select("post_id", "parent_text", "parent_status")


THREAD = """t AS (SELECT c.post_id, c.record_type, c.content, nullif(substr(p.content, 1, 240), '') AS parent_post_summary, nullif(substr(q.content, 1, 240), '') AS parent_comment_summary FROM posts c
    LEFT JOIN posts p ON p.conv_id = c.conv_id AND p.turn = 0 AND c.turn > 0 LEFT JOIN posts q ON q.conv_id = c.conv_id AND q.turn = c.turn - 1 AND c.turn > 1)"""


@query(with_views("posts") + f", {THREAD}" + " SELECT post_id, parent_post_summary, parent_comment_summary, nullif(concat_ws(chr(10), 'Parent post: ' || parent_post_summary, 'Parent comment: ' || parent_comment_summary), '') AS thread_context FROM t")
def jn_thread_context(spark: SparkSession, d: str) -> DataFrame:
    return threads.thread_context(posts(spark, d)).select("post_id", "parent_post_summary", "parent_comment_summary", "thread_context")


# a smaller family set whose patterns occur in the tables' text
PATTERNS = {
    "seller": (r"\ba\b", r"ering"), "official": (r"thble",), "admin": (r"\bich\b",), "question": (r"oning|eaux",), "experience": (r"ertion", r"\bque\b"), "support": (r"the",), "comparison": (r"\bvs\b|hand",),
}


def _count(text: str, patterns) -> str:
    # word limits that know accented letters
    fit = lambda p: p.replace(r"\bvs\b", r"(?:^|[^\pL\pN_])vs(?:$|[^\pL\pN_])") if "|" in p else (r"(?:^|[^\pL\pN_])" + p.replace(r"\b", "") + r"(?:$|[^\pL\pN_])" if p.startswith(r"\b") else p)
    return " + ".join(f"regexp_matches({text}, '{fit(p)}')::INT" for p in patterns)


HEUR = f"""h AS (SELECT *, {", ".join(f"{_count('low', ps)} AS {n}" for n, ps in PATTERNS.items())} FROM (SELECT *, lower(content || coalesce(' ' || thread, '')) AS low FROM (
        SELECT t.*, nullif(concat_ws(chr(10), 'Parent post: ' || parent_post_summary, 'Parent comment: ' || parent_comment_summary), '') AS thread FROM t))),
    l AS (SELECT *, CASE WHEN admin > 0 THEN 'community_admin' WHEN official > 0 AND support > 0 THEN 'brand_official' WHEN seller >= 2 AND question = 0 AND experience = 0 THEN 'seller_affiliate'
        WHEN experience > 0 AND seller = 0 AND official = 0 THEN 'end_user' WHEN question > 0 AND seller = 0 AND official = 0 THEN 'end_user' WHEN comparison > 0 AND experience > 0 THEN 'end_user' ELSE 'unknown' END AS author_role,
        CASE WHEN admin > 0 THEN 0.94::DOUBLE WHEN official > 0 AND support > 0 THEN 0.93::DOUBLE WHEN seller >= 2 AND question = 0 AND experience = 0 THEN 0.92::DOUBLE WHEN experience > 0 AND seller = 0 AND official = 0 THEN 0.9::DOUBLE
        WHEN question > 0 AND seller = 0 AND official = 0 THEN 0.88::DOUBLE WHEN comparison > 0 AND experience > 0 THEN 0.86::DOUBLE ELSE 0.55::DOUBLE END AS c FROM h)"""


@query(with_views("posts") + f", {THREAD}, {HEUR}" + """ SELECT post_id, author_role, CASE WHEN record_type = 'COMMENT' THEN least(c, 0.72) ELSE c END AS confidence, record_type <> 'COMMENT' AND c > 0.55 AS direct,
    concat_ws(',', """ + ", ".join(f"CASE WHEN {n} > 0 THEN '{n}:' || {n} END" for n in PATTERNS) + ") AS signals FROM l")
def sc_label_heuristic(spark: SparkSession, d: str) -> DataFrame:
    p = threads.thread_context(posts(spark, d))
    x = p.select("post_id", labels.heuristic_label("content", "record_type", "thread_context", None, PATTERNS).alias("h"))
    return x.select("post_id", "h.label.author_role", F.col("h.label.label_confidence").alias("confidence"), "h.direct", F.array_join("h.signals", ",").alias("signals"))


RULES = {"seller": ("ieren", "thren"), "official": ("über",), "user": ("tion", "ment"), "asks": ("que", "is")}


@query(f"""SELECT doc_id, CASE WHEN {any_of('x', RULES['seller'])} THEN 'seller_affiliate' WHEN {any_of('x', RULES['official'])} THEN 'brand_official' WHEN {any_of('x', RULES['user'])} THEN 'end_user' ELSE 'unknown' END AS author_role,
    CASE WHEN {any_of('x', RULES['seller'])} THEN 'promotion' WHEN {any_of('x', RULES['official'])} THEN 'support_answer' WHEN {any_of('x', RULES['user'])} THEN CASE WHEN {any_of('x', RULES['asks'])} THEN 'question' ELSE 'experience' END ELSE 'other' END AS content_intent
    FROM (SELECT doc_id, lower(text) AS x FROM documents)""")
def sc_label_rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", labels.rule_label(F.struct("text"), "text", **RULES).alias("l")).select("doc_id", "l.author_role", "l.content_intent")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'end_user' WHEN 1 THEN 'unknown' ELSE 'brand_official' END AS author_role, CASE WHEN doc_id % 4 = 0 THEN 0.5::DOUBLE WHEN doc_id % 4 = 1 THEN 1::DOUBLE ELSE (doc_id % 10) / 10.0::DOUBLE END AS label_confidence,
    CASE WHEN doc_id % 5 = 0 THEN 'fallback_label_applied' ELSE trim(substr(trim(text), 1, 240), '') END AS label_reason, CASE WHEN doc_id % 2 = 0 THEN 'ai' ELSE 'fallback' END AS label_source FROM documents""".replace("trim(substr(trim(text), 1, 240), '')", "substr(trim(text, ' '), 1, 240)"))
def sc_coerce_label(spark: SparkSession, d: str) -> DataFrame:
    t, n = table(spark, d, "documents"), F.col("doc_id")
    raw = F.struct(
        F.when(n % 3 == 0, " End_User ").when(n % 3 == 1, "robot").otherwise("BRAND_OFFICIAL").alias("author_role"), F.lit("x").alias("content_intent"), F.lit(None).cast("string").alias("commerciality_level"), F.lit("HIGH").alias("user_feedback_relevance"),
        F.when(n % 4 == 0, "high").when(n % 4 == 1, "7.5").otherwise(((n % 10) / 10.0).cast("string")).alias("label_confidence"), F.when(n % 5 != 0, F.col("text")).alias("label_reason"), F.when(n % 2 == 0, "AI").otherwise("oracle").alias("label_source"),
    )
    return t.select("doc_id", labels.coerce_label(raw).alias("l")).select("doc_id", "l.author_role", "l.label_confidence", "l.label_reason", "l.label_source")


THEME = {"comparison": ("über", "ció"), "asks": ("tion",), "pain": ("ent",), "positive": ("er",)}
THEMES = f"""th AS (SELECT *, CASE WHEN {any_of('x', THEME['comparison'])} THEN 'comparison' WHEN contains(content, '?') OR {any_of('x', THEME['asks'])} OR starts_with(x, 'hoi') THEN 'question' WHEN {any_of('x', THEME['pain'])} THEN 'pain_point'
    WHEN {any_of('x', THEME['positive'])} THEN 'positive_feedback' ELSE 'other' END AS label FROM (SELECT *, lower({collapse('content')}) AS x FROM gated WHERE reason IS NULL))"""


@query(with_views("candidates") + ", gated AS (SELECT *, NULL AS reason FROM candidates), " + THEMES + " SELECT post_id, label, CASE label WHEN 'pain_point' THEN 'negative' WHEN 'positive_feedback' THEN 'positive' ELSE 'neutral' END AS sentiment FROM th")
def sc_theme_rules(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("post_id", themes.rule_theme("content", **THEME).alias("t")).select("post_id", "t.label", "t.sentiment")


CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC, label_id DESC) AS rn FROM label_history) WHERE rn = 1)"


@query(with_views("label_history") + " SELECT label_id, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC, label_id DESC) = 1 AS is_current FROM label_history")
def wn_current_label(spark: SparkSession, d: str) -> DataFrame:
    return labels.current_labels(label_history(spark, d)).select("label_id", "is_current")


@query(SQL["wn_current_label"])
def wn_label_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The history upserted in two rounds, the second with some of the first again; the newest label of each record is current."""
    at = f"{shared(spark)}/labels-{uuid.uuid4().hex}"
    h = label_history(spark, d)
    upsert.upsert_labels(h.filter("created_at = 1"), at)
    upsert.upsert_labels(h.filter("created_at = 2 or author_role = 'end_user'"), at)
    return spark.read.schema("label_id string, is_current boolean").parquet(at).select("label_id", "is_current")


def _current(spark: SparkSession, d: str) -> DataFrame:
    return labels.current_labels(label_history(spark, d)).filter("is_current")


GATED = """j AS (SELECT p.*, c.author_role, c.user_feedback_relevance, c.label_confidence, c.label_source, upper(coalesce(judge_decision, pre_ai_status)) AS s FROM judged p LEFT JOIN cur c USING (post_id)),
    gated AS (SELECT *, CASE WHEN NOT (s IS NULL OR s IN ('ACCEPTED', 'UNCERTAIN')) THEN 'pre_ai_rejected' WHEN author_role IS NULL THEN 'missing_label' WHEN user_feedback_relevance = 'low' THEN 'low_relevance'
        WHEN author_role <> 'end_user' THEN author_role WHEN label_confidence < 0.45 THEN 'low_confidence' END AS reason FROM j)"""


@query(with_views("candidates", "judged", "label_history") + f", {CURRENT}, {GATED} SELECT ordinal, reason FROM gated")
def gt_audience(spark: SparkSession, d: str) -> DataFrame:
    return themes.with_exclusion(judged(spark, d), _current(spark, d), "end_user_only", "balanced").select("ordinal", "reason")


@query(with_views("candidates", "judged", "label_history") + f", {CURRENT}, {GATED}" + """ SELECT ordinal, CASE WHEN author_role IS NULL THEN 'missing_label' WHEN user_feedback_relevance = 'low' THEN 'low_relevance' WHEN author_role IN ('brand_official', 'community_admin') THEN author_role
    WHEN author_role = 'unknown' AND label_confidence < 0.6 THEN 'low_confidence' END AS seller, CASE WHEN author_role IS NULL THEN 'missing_label' WHEN user_feedback_relevance = 'low' THEN 'low_relevance' WHEN author_role = 'community_admin' THEN author_role END AS brand FROM gated""")
def gt_audience_modes(spark: SparkSession, d: str) -> DataFrame:
    g = themes.with_exclusion(judged(spark, d), _current(spark, d))
    why = lambda a: gates.audience_reason("author_role", "user_feedback_relevance", "label_confidence", a)
    return g.select("ordinal", why("include_seller").alias("seller"), why("include_brand").alias("brand"))


@query(with_views("candidates", "judged", "label_history") + f", {CURRENT}, {GATED}, n AS (SELECT run_id, reason, count(*) AS n FROM gated GROUP BY ALL)" + """ SELECT run_id, sum(n)::BIGINT AS posts_crawled, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS posts_included,
    (sum(n) - coalesce(sum(n) FILTER (reason IS NULL), 0))::BIGINT AS excluded_by_label_count, string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL) AS breakdown, coalesce(sum(n) FILTER (reason IS NULL), 0) < 10 AS few FROM n GROUP BY 1""")
def ag_exclusions(spark: SparkSession, d: str) -> DataFrame:
    e = themes.exclusion_breakdown(themes.with_exclusion(judged(spark, d), _current(spark, d), "end_user_only", "balanced"))
    parts = F.transform(F.array_sort(F.map_entries("excluded_breakdown")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return e.select("run_id", "posts_crawled", "posts_included", "excluded_by_label_count", F.array_join(parts, ",").alias("breakdown"), F.col("warning").isNotNull().alias("few"))


@query(with_views("candidates", "judged", "label_history") + f", {CURRENT}, {GATED}, {THEMES}" + """, n AS (SELECT run_id, label, count(*) AS post_count, min(ordinal) AS pos FROM th GROUP BY ALL), q AS (SELECT run_id, label, content, row_number() OVER (PARTITION BY run_id, label ORDER BY ordinal) AS rn FROM th)
    SELECT n.run_id, n.label, post_count, row_number() OVER (PARTITION BY n.run_id ORDER BY post_count DESC, pos) AS rank, (SELECT string_agg(regexp_replace(regexp_replace(regexp_replace(substr(content, 1, 200), '\\b0\\d{9,10}\\b', '[PHONE]', 'g'), '\\b\\d{9,12}\\b', '[ID_NUMBER]', 'g'), '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+', '[EMAIL]', 'g'), ' || ' ORDER BY rn)
        FROM q WHERE q.run_id = n.run_id AND q.label = n.label AND rn <= 3) AS quotes FROM n""")
def ag_themes(spark: SparkSession, d: str) -> DataFrame:
    found, _ = jobs.answer_run(judged(spark, d), _current(spark, d), ["ordinal"], mode="balanced", **THEME)
    return found.select("run_id", "label", "post_count", "rank", F.array_join("sample_quotes", " || ").alias("quotes"))


@query(with_views("candidates", "judged", "label_history") + f", {CURRENT}, {GATED}" + """, e AS (SELECT * FROM gated WHERE s IS NULL OR s = 'ACCEPTED'), n AS (SELECT run_id, author_role, count(*) AS n FROM e WHERE author_role IS NOT NULL GROUP BY ALL)
    SELECT run_id, count(*) AS records_total, count(author_role) AS records_labeled, count(*) FILTER (label_source = 'fallback') AS records_fallback, count(*) - count(author_role) AS records_failed,
    CASE WHEN count(*) FILTER (label_source = 'fallback') > 0 OR count(*) > count(author_role) THEN 'PARTIAL' ELSE 'DONE' END AS status, (SELECT string_agg(author_role || '=' || n, ',' ORDER BY author_role) FROM n WHERE n.run_id = e.run_id) AS roles FROM e GROUP BY 1""")
def ag_label_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = labels.label_job_summary(judged(spark, d), _current(spark, d))
    parts = F.transform(F.array_sort(F.map_entries("counts_by_author_role")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return s.select("run_id", "records_total", "records_labeled", "records_fallback", "records_failed", "status", F.array_join(parts, ",").alias("roles"))


@query(with_views("candidates", "judged", "label_history") + f", {CURRENT}, {GATED}" + """ SELECT run_id, ordinal, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY crawled_s, post_id) AS rank FROM gated
    WHERE author_role IS NOT NULL AND NOT (author_role = 'end_user' AND user_feedback_relevance <> 'low')) WHERE rank <= 20""")
def gt_label_audit(spark: SparkSession, d: str) -> DataFrame:
    return labels.audit_samples(judged(spark, d), _current(spark, d), "excluded").select("run_id", "ordinal", "rank")


@query(with_views("candidates", "judged") + """, ok AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_url ORDER BY ordinal) AS rn FROM judged WHERE source_url IS NOT NULL AND (pre_ai_status IS NULL OR pre_ai_status = 'ACCEPTED')), u AS (SELECT * FROM ok WHERE rn = 1)
    SELECT ordinal, greatest(1, 3000 // count(*) OVER (PARTITION BY run_id)) AS budget FROM u""")
def jn_comment_tasks(spark: SparkSession, d: str) -> DataFrame:
    return groups.comment_tasks(judged(spark, d).withColumnRenamed("source_url", "post_url"), 3000).select("ordinal", "budget")


def _checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Groups that suppliers stand for: some accepted, some discovered."""
    s = table(spark, d, "supplier").withColumn("gid", F.concat(F.lit("g"), (F.col("s_suppkey") % 37).cast("string")))
    k = F.col("s_suppkey")
    group = F.struct(F.col("gid").alias("group_id"), F.when(k % 3 == 0, "PRIVATE").otherwise("PUBLIC").alias("privacy"), F.when(k % 4 == 0, "approved").when(k % 4 == 1, "pending").otherwise("unknown").alias("status"), (k % 5 == 0).alias("can_access"))
    none = F.array().cast("array<string>")
    return s.select(
        F.col("s_nationkey").cast("string").alias("run_id"), k.alias("step_order"), F.when(k % 7 == 0, F.array("gid")).otherwise(none).alias("accepted_group_ids"), F.array(group).alias("discovered_groups"), none.alias("approved_group_ids"), F.array(group).alias("groups"), none.alias("requested_group_ids")
    )


GROUPS = "g AS (SELECT s_nationkey::VARCHAR AS run_id, s_suppkey AS k, 'g' || (s_suppkey % 37) AS gid FROM supplier)"


@query(f"WITH {GROUPS}, f AS (SELECT run_id, gid, min(k) AS pos FROM g WHERE k % 7 = 0 OR k % 4 = 0 OR k % 5 = 0 GROUP BY ALL) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS ordinal, gid AS group_id FROM f")
def jn_resolve_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.resolve_groups(_checkpoints(spark, d))


@query(f"WITH {GROUPS}, f AS (SELECT run_id, gid, min(k) AS pos FROM g WHERE k % 3 = 0 GROUP BY ALL) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS ordinal, gid AS group_id FROM f")
def jn_private_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.private_groups(_checkpoints(spark, d))


@query(with_views("candidates") + f""", r AS (SELECT path_id, ordinal, post_id, content, row_number() OVER (PARTITION BY path_id ORDER BY ordinal) AS position, row_number() OVER (PARTITION BY path_id ORDER BY ordinal DESC) AS back FROM candidates)
    SELECT path_id, position, post_id, substr({collapse('content')}, 1, 180) AS content_preview, false AS has_image_context FROM r WHERE back <= 3""")
def tx_last_previews(spark: SparkSession, d: str) -> DataFrame:
    return groups.last_previews(candidates(spark, d), ["path_id"], ["ordinal"])


@query(with_views("candidates", "judged") + " SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN 'unknown' ELSE 'end_user' END AS author_role, CASE WHEN ordinal % 3 = 0 THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END AS label_confidence FROM judged")
def ud_batch_scorer(spark: SparkSession, d: str) -> DataFrame:
    """An outside scorer that returns labels for two records of three; the others fall back."""

    def scorer(chunk: pd.DataFrame) -> pd.DataFrame:
        return chunk[chunk["ordinal"] % 3 != 0][["post_id"]].assign(author_role="end_user", confidence=0.5)

    j = judged(spark, d)
    got = labels.score_in_chunks(j.select("post_id", "ordinal"), scorer, "post_id string, author_role string, confidence double")
    f = labels.fallback_label()
    out = j.select("post_id", "ordinal").join(got, "post_id", "left")
    return out.select("ordinal", F.coalesce("author_role", f["author_role"]).alias("author_role"), F.coalesce("confidence", f["label_confidence"]).alias("label_confidence"))


@query("""WITH c AS (SELECT conv_id AS post, turn, ((turn * 7 + conv_id) % 4) * 20 AS indent FROM conversations), x AS (SELECT post, turn::BIGINT AS ordinal, greatest(0, indent - first_value(indent) OVER (PARTITION BY post ORDER BY turn)) AS x FROM c)
    SELECT x.post, x.ordinal, max(p.ordinal) AS parent FROM x LEFT JOIN x p ON p.post = x.post AND p.ordinal < x.ordinal AND p.x < x.x GROUP BY ALL""")
def wn_reply_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Comments of a thread with an indentation."""
    c = table(spark, d, "conversations")
    return threads.nest_by_indent(c.select(F.col("conv_id").alias("post"), F.col("turn").alias("ordinal"), (((F.col("turn") * 7 + F.col("conv_id")) % 4) * 20.0).alias("indent")))


# what the second stage searches: the whole record as JSON, with its first label
RUN = f"""r AS (SELECT l.*, p.run_id, p.parent_post_id, author_role = 'unknown' AS unsure, CASE author_role WHEN 'community_admin' THEN 'other' WHEN 'brand_official' THEN 'support_answer' WHEN 'seller_affiliate' THEN 'promotion'
        WHEN 'unknown' THEN 'other' ELSE CASE c WHEN 0.9 THEN 'experience' WHEN 0.88 THEN 'question' ELSE 'comparison' END END AS intent FROM l JOIN posts p USING (post_id)),
    w AS (SELECT *, record_type <> 'COMMENT' AND NOT unsure AS direct, lower(to_json({{'post_id': post_id, 'record_type': record_type, 'content': substr(content, 1, 900), 'source_url': NULL, 'parent_post_id': parent_post_id, 'parent_post_summary': parent_post_summary,
        'parent_comment_summary': parent_comment_summary, 'thread_context': thread, 'signals': list_filter([{", ".join(f"CASE WHEN {n} > 0 THEN '{n}:' || {n} END" for n in PATTERNS)}], lambda s: s IS NOT NULL), 'heuristic_prior': {{'author_role': author_role, 'content_intent': intent,
        'label_reason': CASE WHEN record_type = 'COMMENT' THEN 'comment_requires_thread_context' WHEN unsure THEN 'ambiguous_content_needs_ai_review' ELSE '' END}}}})::VARCHAR) AS x FROM r),
    s AS (SELECT *, CASE WHEN {any_of('x', T.RULE_SELLER)} THEN 'seller_affiliate' WHEN {any_of('x', T.RULE_OFFICIAL)} THEN 'brand_official' WHEN {any_of('x', T.RULE_USER)} THEN 'end_user' ELSE 'unknown' END AS role2, {any_of('x', T.RULE_ASKS)} AS asks FROM w)"""


@query(with_views("posts") + f", {THREAD}, {HEUR}, {RUN}" + """ SELECT run_id, post_id, CASE WHEN direct THEN author_role ELSE role2 END AS author_role,
    CASE WHEN direct THEN intent ELSE CASE role2 WHEN 'seller_affiliate' THEN 'promotion' WHEN 'brand_official' THEN 'support_answer' WHEN 'end_user' THEN CASE WHEN asks THEN 'question' ELSE 'experience' END ELSE 'other' END END AS content_intent,
    CASE WHEN direct THEN c WHEN role2 = 'unknown' THEN 0.45 ELSE 0.78 END::DOUBLE AS label_confidence, CASE WHEN direct THEN 'heuristic' ELSE 'ai' END AS label_source FROM s""")
def job_label_run(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all eligible records of the threads, with their context."""
    none = F.lit(None).cast("string")
    p = posts(spark, d).withColumns({"judge_decision": none, "pre_ai_status": none, "source_url": none})
    flat, _ = jobs.label_run(p, patterns=PATTERNS)
    return flat.select("run_id", "post_id", "author_role", "content_intent", "label_confidence", "label_source")
