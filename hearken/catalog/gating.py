"""Queries of scores, gates, batches, stop rules and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import clean_payload, normalize_text
from ..functions.text import collapse as collapse_
from ..operators import batches, dedupe, gates, profiles, scoring, termscan
from ..views import candidates, judged, table, with_views
from .text import collapse, norm

QUERIES, SQL = {}, {}

# a demo profile that hits the tables' invented text
ANCHORS, RELATED, NEGATIVE = ("thble", "thtion"), ("erble", "ering", "oning", "ertion"), ("nicht", "mente", "share")
MARKERS = {"promotional": ("ieren", "thren"), "transactional": ("ció",), "experience": ("hand", "rement"), "comparison": ("über",), "question": ("oion",)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lst(x) -> str:
    return "[" + ", ".join(f"'{i}'" for i in x) + "]"


def hits(key: str, terms) -> str:
    return f"len(list_filter({lst(terms)}, lambda t: contains({key}, t)))"


def any_of(key: str, terms) -> str:
    return "(" + " OR ".join(f"contains({key}, '{t}')" for t in terms) + ")"


CLEAN = f"""lines AS (SELECT ordinal, unnest(regexp_split_to_array(content, '[\\r\\n]+')) AS raw, generate_subscripts(regexp_split_to_array(content, '[\\r\\n]+'), 1) AS i FROM candidates),
    keyed AS (SELECT ordinal, i, line, {norm('line')} AS key FROM (SELECT ordinal, i, trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' -') AS line FROM lines)),
    firsts AS (SELECT ordinal, {collapse("string_agg(line, ' ' ORDER BY i)")} AS cleaned FROM (SELECT *, row_number() OVER (PARTITION BY ordinal, key ORDER BY i) AS rn FROM keyed WHERE length(key) >= 3) WHERE rn = 1 GROUP BY 1),
    cleaned AS (SELECT c.*, coalesce(nullif(f.cleaned, ''), trim(content)) AS cleaned, length(coalesce(f.cleaned, '')) < 24 AS short FROM candidates c LEFT JOIN firsts f USING (ordinal)),
    keys AS (SELECT *, {norm('cleaned')} AS key FROM cleaned)"""

SCORE = f"""scored AS (SELECT *, {hits('key', ANCHORS)} AS a, {hits('key', RELATED)} AS r, {hits('key', NEGATIVE)} AS n FROM keys),
    parts AS (SELECT *, least(a * 0.22::DOUBLE, 0.44::DOUBLE) AS pa, least(r * 0.06::DOUBLE, 0.24::DOUBLE) AS pr, (CASE WHEN length(key) >= 24 THEN 0.10::DOUBLE ELSE 0 END) + (CASE WHEN length(key) >= 80 THEN 0.08::DOUBLE ELSE 0 END)
        - (CASE WHEN short THEN 0.08::DOUBLE ELSE 0 END) AS pq, CASE WHEN source_type IN ('SEARCH_IN_GROUP', 'CRAWL_FEED') THEN 0.06::DOUBLE ELSE 0.03::DOUBLE END AS ps, least(n * 0.18::DOUBLE, 0.54::DOUBLE) AS pn FROM scored),
    totals AS (SELECT *, round(pa + pr + pq + ps - pn, 4) AS t FROM parts),
    rel AS (SELECT *, CASE WHEN t >= 0.48 THEN CASE WHEN pn >= 0.36 OR short THEN 'UNCERTAIN' ELSE 'ACCEPTED' END WHEN t >= 0.30 THEN 'UNCERTAIN' ELSE 'REJECTED' END AS status, greatest(t, 0) AS score FROM totals)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    profile = scoring.lit_profile(ANCHORS, RELATED, NEGATIVE)
    c = candidates(spark, d).withColumn("_clean", clean_payload("content", ()))
    return c.withColumn("score", scoring.relevance("content", "record_type", "source_type", scoring.normalized_profile(profile), cleaned=F.col("_clean")))


@query(with_views("candidates") + f", {CLEAN}, {SCORE}" + """ SELECT ordinal, status, score, concat_ws(', ', CASE WHEN a > 0 THEN 'anchor_hits=' || a END, CASE WHEN r > 0 THEN 'related_hits=' || r END, CASE WHEN n > 0 THEN 'negative_hits=' || n END,
    CASE WHEN a + r + n = 0 THEN 'weak_signal' END) AS reason, round(pq, 4) AS quality_score, round(pn, 4) AS negative_penalty FROM rel""")
def sc_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("ordinal", "score.status", "score.score", "score.reason", F.col("score.breakdown.quality_score").alias("quality_score"), F.col("score.breakdown.negative_penalty").alias("negative_penalty"))


@query(with_views("candidates") + f", {CLEAN}, {SCORE} SELECT run_id, status, count(*) AS records, round(avg(score), 6) AS mean_score FROM rel GROUP BY ALL")
def gating_survival(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each run survive gating: the flagship."""
    s = _scored(spark, d).select("run_id", "score.status", "score.score")
    return s.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("score"), 6).alias("mean_score"))


PARENTS = f"""t AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'UNCERTAIN' ELSE 'REJECTED' END AS st, {norm('content')} AS key FROM posts),
    c AS (SELECT c.post_id, c.record_type = 'COMMENT' AS comment, c.key, coalesce(p.key, '') AS pk, p.st AS ps FROM t c LEFT JOIN t p ON p.run_id = c.run_id AND p.post_id = c.parent_post_id),
    h AS (SELECT *, {hits('key', ANCHORS)} AS a, {hits('key', RELATED)} AS r, {hits('key', NEGATIVE)} AS n, {any_of('pk', ANCHORS)} AS near FROM c),
    f AS (SELECT *, least(a * 0.22::DOUBLE, 0.44::DOUBLE) AS fa, least(r * 0.06::DOUBLE, 0.24::DOUBLE) AS fr, (CASE WHEN length(key) >= 24 THEN 0.10::DOUBLE ELSE 0 END) + (CASE WHEN length(key) >= 80 THEN 0.08::DOUBLE ELSE 0 END) AS fq, least(n * 0.18::DOUBLE, 0.54::DOUBLE) AS fn,
        CASE WHEN comment THEN (CASE WHEN ps = 'ACCEPTED' THEN 0.18::DOUBLE ELSE 0 END) + (CASE WHEN pk <> '' THEN 0.06::DOUBLE ELSE 0 END) + (CASE WHEN pk <> '' AND near THEN 0.06::DOUBLE ELSE 0 END) ELSE 0::DOUBLE END AS fp FROM h),
    g AS (SELECT *, round(fa + fr + fq + 0.06::DOUBLE + fp - fn, 4) AS t FROM f)"""


@query(with_views("posts") + f", {PARENTS}" + """ SELECT post_id, CASE WHEN t >= CASE WHEN comment THEN 0.36 ELSE 0.48 END THEN CASE WHEN fn >= 0.36 THEN 'UNCERTAIN' ELSE 'ACCEPTED' END
    WHEN t >= CASE WHEN comment THEN 0.20 ELSE 0.30 END OR comment AND fp >= 0.18 THEN 'UNCERTAIN' ELSE 'REJECTED' END AS status, greatest(t, 0::DOUBLE) AS score, round(fp, 4) AS parent_context_score FROM g""")
def sc_parent_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Scores of posts and comments, comments with what their parents add."""
    from ..operators.threads import parent_context
    from ..views import posts

    none = F.lit(None).cast("string")
    status = F.element_at(F.array(*map(F.lit, ("ACCEPTED", "UNCERTAIN", "REJECTED"))), (F.col("ordinal") % 3 + 1).cast("int"))
    p = posts(spark, d).withColumns({"judge_decision": none, "pre_ai_status": status, "source_url": none, "parent_post_url": none})
    cleaned = F.struct(F.col("content").alias("cleaned"), F.array().cast("array<string>").alias("quality_flags"))
    profile = scoring.normalized_profile(scoring.lit_profile(ANCHORS, RELATED, NEGATIVE))
    s = parent_context(p, p).withColumn("s", scoring.relevance("content", "record_type", F.lit("CRAWL_FEED"), profile, "parent_text", "parent_status", cleaned=cleaned))
    return s.select("post_id", "s.status", "s.score", F.col("s.breakdown.parent_context_score").alias("parent_context_score"))


# some ten thousand terms a run: the words of all conversations, by length, each in three of four runs
TERMS = f"""words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split({norm('text')}, ' ')) AS word FROM conversations) WHERE length(word) >= 4),
    terms AS (SELECT run_id, word, CASE WHEN length(word) >= 9 THEN 'a' WHEN length(word) >= 6 THEN 'r' ELSE 'n' END AS kind FROM words, (SELECT DISTINCT lang AS run_id FROM documents) WHERE substr(md5(run_id || word), 1, 1) < 'c')"""


def _term_profiles(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select(F.explode(F.split(normalize_text("text"), " ")).alias("word")).filter(F.length("word") >= 4).distinct()
    runs = F.explode(F.array(*[F.lit(r[0]) for r in table(spark, d, "documents").select("lang").distinct().collect()])).alias("run_id")  # a handful
    t = words.select("word", runs).filter(F.substring(F.md5(F.concat("run_id", "word")), 1, 1) < "c")
    of = lambda c, name: F.collect_list(F.when(c, F.col("word"))).alias(name)
    n = F.length("word")
    return t.groupBy("run_id").agg(of(n >= 9, "anchors"), of((n >= 6) & (n < 9), "related_terms"), of(n < 6, "negative_terms"))


@query(f"WITH {TERMS}, keys AS (SELECT doc_id AS ordinal, lang AS run_id, {norm('text')} AS key FROM documents)" + """, n AS (SELECT ordinal, kind, count(*) AS n FROM keys JOIN terms USING (run_id) WHERE contains(key, word) GROUP BY ALL)
    SELECT ordinal, coalesce(sum(n) FILTER (kind = 'a'), 0)::BIGINT AS anchors, coalesce(sum(n) FILTER (kind = 'r'), 0)::BIGINT AS related, coalesce(sum(n) FILTER (kind = 'n'), 0)::BIGINT AS negative FROM keys LEFT JOIN n USING (ordinal) GROUP BY 1""")
def sc_term_scan(spark: SparkSession, d: str) -> DataFrame:
    """Terms of large lists per run that occur in each document, by one automaton a run."""
    keys = candidates(spark, d).select("ordinal", "run_id", normalize_text("content").alias("key"))
    s = termscan.scan_terms(keys, _term_profiles(spark, d), "run_id", "key")
    return s.select("ordinal", F.col("hits.anchors").alias("anchors"), F.col("hits.related_terms").alias("related"), F.col("hits.negative_terms").alias("negative"))


JUDGED = f"""ruled AS (SELECT ordinal, path_id, run_id, CASE WHEN {any_of('x', MARKERS['promotional'] + MARKERS['transactional'])} THEN 'REJECTED' WHEN {any_of('x', MARKERS['experience'] + MARKERS['comparison'])} THEN 'ACCEPTED' ELSE 'UNCERTAIN' END AS decision
    FROM (SELECT *, lower({collapse('content')}) AS x FROM candidates)),
    verdicts AS (SELECT *, CASE decision WHEN 'REJECTED' THEN 0.08::DOUBLE WHEN 'ACCEPTED' THEN 0.86::DOUBLE ELSE 0.42::DOUBLE END AS relevance_score, CASE decision WHEN 'REJECTED' THEN 0.9::DOUBLE WHEN 'ACCEPTED' THEN 0.82::DOUBLE ELSE 0.58::DOUBLE END AS confidence_score,
        CASE decision WHEN 'REJECTED' THEN 'commercial_noise' WHEN 'ACCEPTED' THEN 'experience_signal,non_commercial' ELSE 'mixed_signal' END AS reasons FROM ruled)"""


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).withColumn("j", scoring.rule_judge("content", "record_type", markers=MARKERS)).select("ordinal", "path_id", "run_id", "j.*")


@query(with_views("candidates") + f", {JUDGED} SELECT ordinal, decision, relevance_score, confidence_score, reasons FROM verdicts")
def sc_rule_judge(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d).select("ordinal", "decision", "relevance_score", "confidence_score", F.array_join("reason_codes", ",").alias("reasons"))


@query(with_views("candidates", "judged") + """ SELECT ordinal, CASE WHEN judge_decision IS NULL THEN CASE WHEN r >= 0.65 THEN 'ACCEPTED' WHEN r <= 0.25 THEN 'REJECTED' ELSE 'UNCERTAIN' END ELSE judge_decision END AS decision, r AS relevance_score,
    judge_confidence_score AS confidence_score, 'spec:' || post_id AS cache_key FROM (SELECT *, CASE WHEN ordinal % 9 = 0 THEN 0.0::DOUBLE ELSE least(1, judge_relevance_score * 1.5) END AS r FROM judged)""")
def sc_normalize_judge(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("ordinal") % 9 == 0, "n/a").otherwise((F.col("judge_relevance_score") * 1.5).cast("string"))
    j = judged(spark, d).withColumn("n", scoring.normalize_judge(F.lower("judge_decision"), raw, "judge_confidence_score", F.col("judge_reason_codes"), F.lit("spec"), F.col("post_id")))
    return j.select("ordinal", "n.decision", "n.relevance_score", "n.confidence_score", "n.cache_key")


@query(with_views("candidates") + f", {CLEAN}, {SCORE} SELECT ordinal, status AS decision, score AS relevance_score, CASE status WHEN 'ACCEPTED' THEN 0.85::DOUBLE WHEN 'UNCERTAIN' THEN 0.55::DOUBLE ELSE 0.9::DOUBLE END AS confidence_score FROM rel")
def sc_fallback_judge(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("ordinal", scoring.fallback_judge(F.col("score")).alias("j")).select("ordinal", "j.decision", "j.relevance_score", "j.confidence_score")


@query(with_views("posts") + f""" SELECT post_id, CASE WHEN key = '' THEN 'empty_content' WHEN record_type = 'COMMENT' AND length(key) < 60 THEN 'comment_too_short'
    WHEN record_type = 'COMMENT' AND {any_of('key', ('erble', 'ment'))} AND len(string_split(key, ' ')) <= 8 THEN 'transactional_only_comment' END AS reason FROM (SELECT *, {norm("regexp_replace(content, '[\\r\\n]+', ' ', 'g')")} AS key FROM posts)""")
def gt_hard_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..views import posts

    policy = F.struct(F.lit(60).alias("minimum_comment_text_length"), F.lit(True).alias("reject_transactional_only_comments"))
    return posts(spark, d).select("post_id", gates.hard_filter("content", "record_type", policy, ("erble", "ment"), cleaned=F.col("content")).alias("reason"))


@query("SELECT s_suppkey, s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 OR (s_suppkey % 4 = 2 AND s_suppkey % 3 <> 0) AS broker FROM supplier")
def gt_broker_group(spark: SparkSession, d: str) -> DataFrame:
    """Names with two broker terms; one and a number; one and a lead (unless it is a discussion); none."""
    k, n = F.col("s_suppkey") % 4, F.col("s_name")
    lead = F.when(F.col("s_suppkey") % 3 == 0, F.lit("review tài chính hỗ trợ")).otherwise(F.lit("Tài chính hỗ trợ"))
    name = F.when(k == 0, F.concat(F.lit("Vay tiền & mở thẻ "), n)).when(k == 1, F.concat(F.lit("Tín dụng "), n)).when(k == 2, lead).otherwise(n)
    return table(spark, d, "supplier").select("s_suppkey", gates.broker_group(name).alias("broker"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'source_prefilter_broker_group' WHEN page_id % 5 = 1 AND contains(url, 'thththe') = false AND (contains(lower(url), 'example')) THEN 'source_prefilter_official_brand_page' END AS reason FROM pages")
def gt_source_prefilter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    group = F.when(F.col("page_id") % 3 == 0, "vay von tra gop").otherwise("cong dong")
    url = F.when(F.col("url").contains("thththe"), "https://other.test/posts/1").otherwise(F.concat(F.lit("https://"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("x")), F.lit("/posts/1")))
    family = F.when(F.col("page_id") % 5 == 1, "brand").otherwise("question")
    none = F.array().cast("array<string>")
    spec = F.struct(F.array(F.lit("consumer")).alias("target_author_types"), none.alias("non_target_author_types"), none.alias("hard_reject_signals"), none.alias("target_signal_types"), F.lit("").alias("research_objective"))
    return p.withColumns({"g": group, "u": url, "f": family}).select("page_id", gates.source_prefilter(spec, "g", "u", F.array(F.lit("Example"), F.lit("abc")), "f").alias("reason"))


@query(with_views("candidates", "judged") + " SELECT run_id, count(*) FILTER (s IS NULL OR s = 'ACCEPTED') AS strict, count(*) FILTER (s IS NULL OR s IN ('ACCEPTED', 'UNCERTAIN')) AS balanced FROM (SELECT *, coalesce(judge_decision, pre_ai_status) AS s FROM judged) GROUP BY 1")
def gt_eligible(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return j.groupBy("run_id").agg(*[F.count_if(gates.eligible("judge_decision", "pre_ai_status", m)).alias(m) for m in ("strict", "balanced")])


@query(with_views("candidates") + ", b AS (SELECT path_id, ordinal, (row_number() OVER (PARTITION BY path_id ORDER BY ordinal) - 1) // 20 + 1 AS batch_index FROM candidates) SELECT path_id, batch_index, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM b GROUP BY ALL")
def wn_batches(spark: SparkSession, d: str) -> DataFrame:
    b = batches.assign_batches(candidates(spark, d), ["path_id"], ["ordinal"])
    return b.groupBy("path_id", "batch_index").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


V1 = """h AS (SELECT path_id, batch_index, count(*) AS batch_size, count(*) FILTER (status = 'ACCEPTED') AS accepted_count, count(*) FILTER (status = 'UNCERTAIN') AS uncertain_count, count(*) FILTER (status = 'ACCEPTED' AND score >= 0.7) AS strong_accept_count
    FROM (SELECT *, (row_number() OVER (PARTITION BY path_id ORDER BY ordinal) - 1) // 20 + 1 AS batch_index FROM rel) GROUP BY ALL)"""


@query(with_views("candidates") + f", {CLEAN}, {SCORE}, {V1}" + """ SELECT path_id, batch_index, accepted_count, uncertain_count, strong_accept_count, round(accepted_count / batch_size, 4) AS accepted_ratio,
    CASE WHEN accepted_count / batch_size >= 0.25 OR strong_accept_count >= 3 THEN 'continue' WHEN accepted_count / batch_size < 0.10 AND uncertain_count / batch_size < 0.20 THEN 'weak' ELSE 'continue' END AS decision FROM h""")
def ag_batch_health_v1(spark: SparkSession, d: str) -> DataFrame:
    s = batches.assign_batches(_scored(spark, d), ["path_id"], ["ordinal"]).select("path_id", "batch_index", "score.status", F.col("score.score").alias("score"))
    return batches.batch_health_v1(s, ["path_id", "batch_index"]).select("path_id", "batch_index", "accepted_count", "uncertain_count", "strong_accept_count", "accepted_ratio", "decision")


# paths of eight records a batch, so that the rules come into play on small tables
B8 = """b AS (SELECT *, (row_number() OVER (PARTITION BY path_id ORDER BY ordinal) - 1) // 8 + 1 AS batch_index FROM verdicts),
    h AS (SELECT path_id, batch_index, count(*) AS batch_size, count(*) FILTER (decision = 'ACCEPTED') AS acc, count(*) FILTER (decision = 'UNCERTAIN') AS unc, count(*) FILTER (decision = 'ACCEPTED' AND confidence_score >= 0.75 AND relevance_score >= confidence_score * 0.6) AS high,
        round(avg(confidence_score), 4) AS mean_confidence FROM b GROUP BY ALL),
    hd AS (SELECT *, CASE WHEN acc / batch_size >= 0.15 OR high / batch_size >= 0.05 THEN 'continue' WHEN unc / batch_size >= 0.25 THEN 'reformulate' ELSE 'weak' END AS decision FROM h)"""


def _health(spark: SparkSession, d: str) -> DataFrame:
    b = batches.assign_batches(_ruled(spark, d), ["path_id"], ["ordinal"], 8)
    return batches.batch_health_v2(b, ["path_id", "batch_index"])


@query(with_views("candidates") + f", {JUDGED}, {B8} SELECT path_id, batch_index, acc AS accepted_count, unc AS uncertain_count, high AS high_conf_accept_count, mean_confidence, decision FROM hd")
def ag_batch_health_v2(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).select("path_id", "batch_index", "accepted_count", "uncertain_count", "high_conf_accept_count", "mean_confidence", "decision")


# recursive: the rules as they are applied, batch by batch
STOP = """WITH RECURSIVE {views}, walk AS (
    SELECT path_id, batch_index, batch_size, acc, decision, acc AS ta, batch_size AS ts, CASE WHEN decision = 'weak' THEN 1 ELSE 0 END AS weak, CASE WHEN acc = 0 THEN 1 ELSE 0 END AS zero,
        {verdict0} AS stop_reason, ({verdict0}) IS NOT NULL OR (decision = 'reformulate' AND acc = 0) AS ended FROM hd WHERE batch_index = 1
    UNION ALL
    SELECT h.path_id, h.batch_index, h.batch_size, h.acc, h.decision, w.ta + h.acc, w.ts + h.batch_size, CASE WHEN h.decision = 'weak' THEN w.weak + 1 ELSE 0 END, CASE WHEN h.acc = 0 THEN w.zero + 1 ELSE 0 END,
        {verdict}, ({verdict}) IS NOT NULL OR (h.decision = 'reformulate' AND w.ta + h.acc = 0) FROM walk w JOIN hd h ON h.path_id = w.path_id AND h.batch_index = w.batch_index + 1 WHERE NOT w.ended)"""
WALKED = " SELECT path_id, batch_index, ta AS total_accepted, ts AS total_scanned, stop_reason, CASE WHEN stop_reason IS NOT NULL THEN 'stop' WHEN ended THEN 'reformulate' ELSE 'continue' END AS batch_decision FROM walk"


def _verdict(ta: str, ts: str, weak: str, zero: str, scanned: int) -> str:
    return f"CASE WHEN {ts} >= {scanned} AND {ta} < 3 THEN 'min_accepts_not_reached' WHEN {ta} = 0 AND {zero} >= 2 THEN 'zero_accepted_batches_exceeded' WHEN {weak} >= 2 THEN 'weak_batches_exceeded' END"


def stop_sql(views: str, scanned: int) -> str:
    """The rules over ``hd``, the batches of each path, as the last of some views."""
    weak, zero = "CASE WHEN {0}decision = 'weak' THEN {1} ELSE 0 END", "CASE WHEN {0}acc = 0 THEN {1} ELSE 0 END"
    first = _verdict("acc", "batch_size", f"({weak.format('', 1)})", f"({zero.format('', 1)})", scanned)
    later = _verdict("(w.ta + h.acc)", "(w.ts + h.batch_size)", f"({weak.format('h.', 'w.weak + 1')})", f"({zero.format('h.', 'w.zero + 1')})", scanned)
    return STOP.format(views=views, verdict0=first, verdict=later)


@query(stop_sql(with_views("candidates").removeprefix("WITH ") + f", {JUDGED}, {B8}", 24) + WALKED)
def wn_stop_rules(spark: SparkSession, d: str) -> DataFrame:
    b = batches.apply_stop_rules(_health(spark, d), ["path_id"], max_scanned=24)
    return b.select("path_id", "batch_index", "total_accepted", "total_scanned", "stop_reason", "batch_decision")


@query(stop_sql(with_views("candidates").removeprefix("WITH ") + f", {JUDGED}, {B8}", 24) + """, p AS (SELECT path_id, sum(hd.batch_size)::BIGINT AS collected_count, sum(hd.acc)::BIGINT AS accepted_count, max(batch_index) AS n, arg_max(w.stop_reason, batch_index) FILTER (w.stop_reason IS NOT NULL) AS why, max(w.ended::INT) = 1 AS ended
    FROM walk w JOIN hd USING (path_id, batch_index) GROUP BY 1)
    SELECT path_id, collected_count, accepted_count, CASE WHEN why IS NOT NULL THEN 'stop' WHEN ended THEN 'reformulate' ELSE 'continue' END AS last_decision, CASE WHEN why IS NOT NULL THEN why WHEN ended THEN 'uncertain_reformulation_triggered' END AS stop_reason, accepted_count = 0 AND ended AS should_reformulate FROM p""")
def wn_path_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What each path's caller sees of its batches."""
    s = batches.path_summaries(batches.apply_stop_rules(_health(spark, d), ["path_id"], max_scanned=24), ["path_id"])
    return s.select("path_id", "collected_count", "accepted_count", "last_decision", "stop_reason", "should_reformulate")


@query(with_views("candidates") + """, k AS (SELECT run_id, path_id, ordinal, coalesce(source_url, post_id) AS key, source_url IS NOT NULL AS has, row_number() OVER (PARTITION BY run_id, path_id, coalesce(source_url, post_id) ORDER BY ordinal) AS rb FROM candidates),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY ordinal) AS rr FROM k WHERE rb = 1)
    SELECT k.run_id, count(*) FILTER (k.rb = 1 AND NOT (k.has AND r.rr > 1)) AS inserted, count(*) FILTER (k.rb > 1) AS duplicate_in_batch, count(*) FILTER (k.rb = 1 AND k.has AND r.rr > 1) AS duplicate_in_run
    FROM k LEFT JOIN r USING (ordinal) GROUP BY 1""")
def ag_dedupe_counters(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.dedupe_counters(dedupe.mark_duplicates(candidates(spark, d), "run_id", ["path_id"], ["ordinal"]), ["run_id"])


@query(with_views("candidates") + """, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, path_id, coalesce(source_url, post_id) ORDER BY ordinal) AS rb FROM candidates),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(source_url, post_id) ORDER BY ordinal) AS rr FROM k WHERE rb = 1) SELECT run_id, path_id, ordinal, post_id FROM r WHERE source_url IS NULL OR rr = 1""")
def wn_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_first(candidates(spark, d), "run_id", ["path_id"], ["ordinal"]).select("run_id", "path_id", "ordinal", "post_id")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = candidates(spark, d)
    return c.filter(F.col("ordinal") % 2 == 0), c.filter(F.col("ordinal") % 2 == 1)


@query(with_views("candidates") + """ SELECT n.ordinal, EXISTS (SELECT 1 FROM candidates s WHERE s.ordinal % 2 = 0 AND s.post_id = 'd' || (n.ordinal // 3 * 2)) AS known FROM candidates n
    WHERE n.ordinal % 2 = 1 AND NOT EXISTS (SELECT 1 FROM candidates s WHERE s.ordinal % 2 = 0 AND s.run_id = n.run_id AND s.source_url = n.source_url)""")
def jn_new_vs_stored(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    fresh = dedupe.new_only(new, old)
    probe = fresh.select("ordinal", F.concat(F.lit("d"), (F.floor(F.col("ordinal") / 3) * 2).cast("string")).alias("post_id"))
    hit = dedupe.known_ids(probe, old).select("ordinal", F.lit(True).alias("known"))
    return fresh.select("ordinal").join(hit, "ordinal", "left").select("ordinal", F.coalesce("known", F.lit(False)).alias("known"))


@query(with_views("candidates") + """, n AS (SELECT run_id, 'p' || (ordinal % 200) AS original_post_id, ordinal, ordinal % 200 < 100 AS taken FROM candidates WHERE ordinal % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, original_post_id ORDER BY ordinal) - CASE WHEN taken THEN 1 ELSE 2 END AS place FROM n)
    SELECT run_id, ordinal, original_post_id, CASE WHEN place < 0 THEN original_post_id WHEN place = 0 THEN original_post_id || '--' || run_id ELSE original_post_id || '--' || run_id || '-' || place END AS post_id FROM r""")
def wn_rename_collisions(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    none = F.lit(None).cast("string")
    stored = spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("post_id"), F.lit("old").alias("run_id"), none.alias("source_url"))
    stored = stored.join(old.select(F.concat(F.lit("p"), (F.col("ordinal") % 100).cast("string")).alias("post_id")).distinct(), "post_id", "left")
    inc = new.select("run_id", "ordinal", F.concat(F.lit("p"), (F.col("ordinal") % 200).cast("string")).alias("post_id"), none.alias("source_url"), none.alias("parent_post_id"), none.alias("parent_post_url"))
    return dedupe.rename_collisions(inc, stored, ["ordinal"]).select("run_id", "ordinal", "original_post_id", "post_id")


@query(with_views("candidates") + """, u AS (SELECT run_id, path_id AS v, 0 AS part, min(ordinal) AS pos FROM candidates WHERE ordinal % 3 = 0 GROUP BY ALL UNION ALL SELECT run_id, path_id, 1, min(ordinal) FROM candidates WHERE ordinal % 3 = 1 GROUP BY ALL),
    f AS (SELECT run_id, v, min({'part': part, 'pos': pos}) AS pos FROM u GROUP BY ALL) SELECT run_id, v AS path_id, row_number() OVER (PARTITION BY run_id ORDER BY pos, v) AS ordinal FROM f""")
def so_ordered_union(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return dedupe.ordered_union([c.filter("ordinal % 3 = 0"), c.filter("ordinal % 3 = 1")], ["run_id"], "path_id")


@query("SELECT l_returnflag, l_suppkey, n AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, pos, l_suppkey) AS rank FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, min(l_orderkey) AS pos FROM lineitem GROUP BY ALL)) WHERE rank <= 5")
def so_top_k(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.top_k_first_seen(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_orderkey", 5).select("l_returnflag", "l_suppkey", "count", "rank")


REASONS = """x AS (SELECT path_id, ordinal, unnest(judge_reason_codes) AS reason FROM judged WHERE judge_decision = 'REJECTED'),
    k AS (SELECT path_id, ordinal * 10 AS pos, CASE WHEN regexp_matches(reason, 'promot|seller|commercial|cta|transactional') THEN 'promo_noise' WHEN regexp_matches(reason, 'target|mention|brand|entity') THEN 'target_weak'
        WHEN regexp_matches(reason, 'phi|fee|lai|interest') THEN 'cost_gap' ELSE 'generic_weak' END AS c FROM x WHERE reason <> 'low_signal')"""


@query(with_views("candidates", "judged") + f", {REASONS}, n AS (SELECT path_id, c, count(*) AS n, min(pos) AS pos FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY n DESC, pos) AS rn FROM n)" + """
    SELECT p.path_id, coalesce(r.c, 'generic_weak') AS reason_cluster FROM (SELECT DISTINCT path_id FROM candidates) p LEFT JOIN r ON r.path_id = p.path_id AND rn = 1""")
def pr_reason_clusters(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    r = j.filter("judge_decision = 'REJECTED'").select("path_id", F.explode("judge_reason_codes").alias("reason"), (F.col("ordinal") * 10).alias("ordinal")).filter("reason <> 'low_signal'")
    paths = j.select("path_id", F.col("path_id").alias("query"), F.lit("").alias("signals")).distinct()
    return profiles.cluster_reject_reasons(r, paths)


WORDS = f"""w AS (SELECT doc_id, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '') AS ws FROM documents),
    a AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN [ws[1], ws[2] || ' ' || ws[3], ws[3] || ' ' || ws[4] || ' ' || ws[5]] ELSE ['x'] END AS anchors, CASE WHEN len(ws) >= 5 THEN ws[3] || ' ' || ws[5] ELSE 'x' END AS ref FROM w),
    e AS (SELECT doc_id, ref, unnest(anchors) AS c, generate_subscripts(anchors, 1) AS i FROM a),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS rn FROM e) WHERE rn = 1),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (c = ref)::INT DESC, contains(c, ref)::INT DESC, len(list_distinct(list_intersect(string_split(c, ' '), string_split(ref, ' ')))) DESC, contains(c, ' ')::INT DESC, len(string_split(c, ' ')) DESC, i) AS best FROM u)"""


@query(f"WITH {WORDS} SELECT doc_id, c AS anchor FROM s WHERE best = 1")
def pr_select_anchor(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import normalize_text

    w = table(spark, d, "documents").select("doc_id", F.filter(F.split(normalize_text("text"), " "), lambda x: x != "").alias("ws"))
    many = F.size("ws") >= 5
    at = lambda i: F.try_element_at("ws", F.lit(i))
    anchors = F.when(many, F.array(at(1), F.concat_ws(" ", at(2), at(3)), F.concat_ws(" ", at(3), at(4), at(5)))).otherwise(F.array(F.lit("x")))
    a = w.select("doc_id", anchors.alias("anchors"), F.when(many, F.concat_ws(" ", at(3), at(5))).otherwise("x").alias("ref"))
    return a.select("doc_id", profiles.select_anchor("ref", F.col("anchors")).alias("anchor"))


@query("""WITH p AS (SELECT doc_id, 'brand: ' || a || ' ' || b || ' ' || c || ', ' || a || ' (' || b || ') ; keyword ' || c || '|' || a || ' ' || b AS v, a, b, c FROM (SELECT doc_id, 'w' || (doc_id % 7) AS a, 'x' || (doc_id % 11) AS b, 'long' || doc_id AS c FROM documents))
    SELECT doc_id, a || ' ' || b || ' ' || c AS picked FROM p""")
def pr_pick_query(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("w"), (n % 7).cast("string")).alias("a"), F.concat(F.lit("x"), (n % 11).cast("string")).alias("b"), F.concat(F.lit("long"), n.cast("string")).alias("c"))
    v = F.concat(F.lit("brand: "), "a", F.lit(" "), "b", F.lit(" "), "c", F.lit(", "), "a", F.lit(" ("), "b", F.lit(") ; keyword "), "c", F.lit("|"), "a", F.lit(" "), "b")
    return t.withColumn("v", v).select("doc_id", profiles.pick_search_query("v", F.lit("")).alias("picked"))


LIKE_BROKERS, LIKE_TALK, LIKE_LEADS = ("ering", "oning", "thble"), ("hand", "ertion"), ("erble", "there", "mente")


@query(with_views("posts") + f""", k AS (SELECT post_id, content, {norm('content')} AS key FROM posts), n AS (SELECT *, {hits('key', LIKE_BROKERS)} AS n FROM k)
    SELECT post_id, key <> '' AND (n >= 2 OR n >= 1 AND (regexp_matches(content, '[0-9]{{7,}}') OR NOT {any_of('key', LIKE_TALK)} AND {any_of('key', LIKE_LEADS)})) AS broker FROM n""")
def gt_broker_names(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as names of groups, under terms that occur in them."""
    from ..views import posts

    return posts(spark, d).select("post_id", gates.broker_group("content", LIKE_BROKERS, LIKE_TALK, LIKE_LEADS).alias("broker"))


@query(with_views("posts") + f" SELECT post_id, {any_of(norm('content'), LIKE_TALK)} AS enabled FROM posts")
def pr_source_filter_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as what a spec is after: every other word as signals to reject, the rest as objective."""
    from ..views import posts

    none, words = F.array().cast("array<string>"), F.split(collapse_("content"), " ")
    half = F.size(words) - F.floor(F.size(words) / 2)
    spec = F.struct(none.alias("target_author_types"), none.alias("non_target_author_types"), F.slice(words, F.lit(1), half.cast("int")).alias("hard_reject_signals"), none.alias("target_signal_types"), F.array_join(F.slice(words, (half + 1).cast("int"), F.size(words)), " ").alias("research_objective"))
    return posts(spark, d).select("post_id", gates.source_filter_enabled(spec, LIKE_TALK).alias("enabled"))


@query(with_views("posts") + f""", x AS (SELECT post_id, {collapse('content')} AS x FROM (SELECT post_id, regexp_replace(content, '[:\\r\\n]', ' ', 'g') AS content FROM posts)),
    w AS (SELECT post_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT post_id, regexp_split_to_array(regexp_replace(x, '\\((.*?)\\)', ' ', 'g'), '[,;|/]+') AS ps FROM x)),
    c AS (SELECT post_id, i, regexp_replace({collapse('p')}, '^[ -]+|[ -]+$', '', 'g') AS p FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY post_id, lower(p) ORDER BY i) AS again FROM c WHERE p <> ''),
    v AS (SELECT *, len(string_split(p, ' ')) AS n FROM o WHERE again = 1),
    b AS (SELECT post_id, p, row_number() OVER (PARTITION BY post_id ORDER BY (n >= 2)::INT DESC, least(n, 5) DESC, length(lower(p)) DESC, i) AS r FROM v WHERE n <= 5 AND NOT {any_of('lower(p)', T.PLACEHOLDERS)} AND lower(p) NOT IN ({lst([*T.KEYWORD_GROUPS, 'pain points'])[1:-1]})),
    f AS (SELECT post_id, array_to_string(string_split(p, ' ')[1:5], ' ') AS p FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY i) AS r FROM v) WHERE r = 1)
    SELECT post_id, coalesce(b.p, f.p, 'research') AS picked FROM posts LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (post_id) LEFT JOIN f USING (post_id)""")
def pr_pick_query_texts(spark: SparkSession, d: str) -> DataFrame:
    """The best search query among the pieces of whole texts (none has a group's prefix)."""
    from ..views import posts

    return posts(spark, d).select("post_id", profiles.pick_search_query(F.regexp_replace("content", "[:\\r\\n]", " "), F.lit("")).alias("picked"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN trim(regexp_extract(trim(regexp_extract('find: ' || text, '(?s)^[^:]*:(.*)$', 1)), '(?s)^(.*?)(?: in |$)', 1)) ELSE trim(regexp_extract(text, '(?s)^(.*?)(?: in |$)', 1)) END, ''), CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'research' END) AS query FROM documents""")
def pr_resolve_query(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as targets of search steps, every other one with a head."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("find: "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", profiles.resolve_search_query(t).alias("query"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for each source: its topic and keywords are the words that most of its documents have."""
    words = F.array_distinct(F.filter(F.split("text", r"[\s.,]+"), lambda x: x != ""))
    n = table(spark, d, "documents").select("source", F.explode(words).alias("word")).groupBy("source", "word").count()
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("count"), "word"))).filter("rn <= 32")
    p = top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]).alias("ws"))
    names = ("brand", "pain_points", "sentiment", "behavior", "comparison")
    kw = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.slice("ws", 6 * i - 3, 6) for i in range(1, 6)]))
    return p.select(F.col("source").alias("context_id"), F.array_join(F.slice("ws", 1, 2), " ").alias("topic"), kw.alias("keywords"))


def _spec():
    return F.struct(F.lit("find real fee and trust problems").alias("research_objective"), F.array(F.lit("pain_point")).alias("target_signal_types"), F.array(F.lit("fee")).alias("must_have_signals"))


def _once(c: str) -> str:
    """Elements of a list whose comparison key occurs first there; empty ones go."""
    return f"list_filter({c}, lambda x, i: {norm('x')} <> '' AND list_position(list_transform({c}, lambda y: {norm('y')}), {norm('x')}) = i)"


_SIGNALS = "find real fee and trust problems pain point fee"
PROFILES = f"""t AS (SELECT source, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[\\s.,]+'), lambda x: x <> ''))) AS word FROM documents), n AS (SELECT source, word, count(*) AS c FROM t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, word) AS rn FROM n), w AS (SELECT source AS context_id, list(word ORDER BY rn) AS ws FROM r WHERE rn <= 32 GROUP BY 1),
    p AS (SELECT context_id, array_to_string(ws[1:2], ' ') AS topic, ws[3:8] AS w1, ws[9:14] AS w2, ws[15:20] AS w3, ws[21:26] AS w4, ws[27:32] AS w5, ws[3:32] AS flat FROM w),
    q AS (SELECT *, {_once('w1')} AS brand, {_once('w2')} AS pain, {_once('w3')} AS sentiment, {_once('w4')} AS behavior, {_once('w5')} AS comparison, {norm('topic')} AS nq FROM p),
    l AS (SELECT *, list_concat(brand, [topic]) AS al, list_concat(pain, behavior, comparison, sentiment) AS rl, {any_of('nq', T.IMAGE_TERMS)} AS pictures, {any_of(f"(nq || ' {_SIGNALS}')", T.IMAGE_TERMS)} AS seen,
        nq LIKE '% vs' OR contains(nq, ' vs ') AS unfinished FROM q),
    a AS (SELECT *, {_once('al')} AS anchors, ({_once('rl')})[1:16] AS related FROM l),
    e AS (SELECT context_id, nq, unnest(anchors) AS c, generate_subscripts(anchors, 1) AS i FROM a), ek AS (SELECT *, {norm('c')} AS k FROM e),
    b AS (SELECT context_id, trim(c) AS base FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY (k = nq)::INT DESC, (nq <> '' AND contains(k, nq))::INT DESC,
        len(list_intersect(list_distinct(string_split(k, ' ')), list_distinct(string_split(nq, ' ')))) DESC, contains(k, ' ')::INT DESC, len(string_split(k, ' ')) DESC, i) AS best FROM ek) WHERE best = 1),
    f AS (SELECT a.*, base, list_concat([{{'i': 'brand', 'q': base}}], list_transform(pain[1:2], lambda x: {{'i': 'pain_point', 'q': x}}), [{', '.join(f"{{'i': 'question', 'q': base || ' {x}'}}" for x in T.QUESTION_SUFFIXES[:2])}],
        list_transform(comparison[1:2], lambda x: {{'i': 'comparison', 'q': x}}), [{', '.join(f"{{'i': 'complaint', 'q': '{x} ' || base}}" for x in T.COMPLAINT_PREFIXES[:2])}],
        CASE WHEN pictures THEN [{{'i': 'image_review', 'q': base || ' review co hinh anh'}}, {{'i': 'before_after', 'q': base || ' truoc va sau'}}] ELSE [] END)[1:8] AS fs FROM a JOIN b USING (context_id)),
    g AS (SELECT *, coalesce((list_filter(fs, lambda x: {norm('x.q')} <> '' AND (contains(nq, {norm('x.q')}) OR contains({norm('x.q')}, nq))))[1].i, CASE WHEN contains(topic, '?') OR contains(lower(topic), 'co ') THEN 'question' ELSE 'generic' END) AS family,
        CASE WHEN seen THEN ['image_review', 'before_after', 'pain_point', 'question', 'comparison', 'complaint', 'brand'] WHEN unfinished THEN ['comparison', 'pain_point', 'question', 'complaint'] WHEN {any_of('nq', T.COMPLAINT_TERMS)} THEN ['complaint', 'pain_point', 'question', 'comparison']
            ELSE ['complaint', 'pain_point', 'question', 'comparison', 'brand'] END AS intents,
        list_concat(CASE WHEN seen THEN [base || ' review co hinh anh', base || ' truoc va sau', base || ' screenshot'] ELSE [] END, [base || ' bi lua', base || ' phi cao', base || ' lai suat cao', base || ' review', base || ' co uy tin khong'], list_transform(related[1:2], lambda x: trim(base || ' ' || x))) AS wide FROM f),
    h AS (SELECT *, list_concat(CASE WHEN unfinished THEN [] ELSE list_concat([topic], list_filter({_once('wide')}, lambda x: {norm('x')} <> nq)) END,
        flatten(list_transform(intents, lambda t, i: list_concat(list_transform(list_filter(fs, lambda x: x.i = t AND trim(x.q) <> ''), lambda x: trim(x.q)), CASE WHEN unfinished AND i = 1 THEN [topic] ELSE [] END))), [topic]) AS every FROM g),
    s AS (SELECT *, {_once('every')} AS best FROM h), z AS (SELECT *, list_concat([base || ' phi cao', base || ' lai suat cao'], best[1:3]) AS again FROM s),
    m AS (SELECT context_id, unnest(flat) AS c, generate_subscripts(flat, 1) AS i, list_distinct(regexp_extract_all(lower(topic), '[\\pL\\pN\\pM_]+')) AS own FROM p),
    mk AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(c), '[\\pL\\pN\\pM_]+')), own)) AS n FROM m), mb AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY n DESC, length(c) DESC, i) AS rn FROM mk WHERE n > 0),
    md AS (SELECT context_id, string_agg(c, '|' ORDER BY rn) AS related_keywords FROM (SELECT *, row_number() OVER (PARTITION BY context_id, lower(c) ORDER BY rn) AS again FROM mb WHERE rn <= 5) WHERE again = 1 GROUP BY 1)"""


@query(f"WITH {PROFILES}" + f""" SELECT context_id, array_to_string(anchors[1:8], '|') AS anchors, array_to_string(related, '|') AS related, array_to_string(list_transform(fs, lambda x: x.i || '=' || x.q), '|') AS families, family,
    array_to_string(best[1:4], '|') AS suggested, array_to_string((list_filter({_once('again')}, lambda x: {norm('x')} <> nq))[1:2], '|') AS rewrites, coalesce(related_keywords, '') AS related_keywords FROM z LEFT JOIN md USING (context_id)""")
def pr_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with suggested queries and rewrites; tested against a plain model on small inputs."""
    p = profiles.build_profile(_contexts(spark, d))
    q, profile, spec = F.col("topic"), F.col("profile"), _spec()
    return p.select(
        "context_id", F.array_join("profile.anchors", "|").alias("anchors"), F.array_join("profile.related_terms", "|").alias("related"), F.array_join(F.transform("profile.query_families", lambda f: F.concat(f["intent"], F.lit("="), f["query"])), "|").alias("families"),
        profiles.infer_query_family(q, profile).alias("family"), F.array_join(profiles.suggest_queries(q, profile, spec, 4), "|").alias("suggested"), F.array_join(profiles.build_reformulations(q, profile, spec, F.lit("cost_gap")), "|").alias("rewrites"),
        F.array_join(profiles.related_keywords(q, F.col("keywords")), "|").alias("related_keywords"),
    )


# the gate of a crawl: interface words go, hard filters come first, then the rules; batches of twenty
GATE = CLEAN.replace("length(key) >= 3", f"length(key) >= 3 AND key NOT IN ({lst(T.UI_NOISE_TERMS)[1:-1]})") + f""",
    gate AS (SELECT *, CASE WHEN key = '' THEN 'empty_content' WHEN key IN ({lst(T.SEVERE_UI_NOISE)[1:-1]}) THEN 'ui_noise_only' END AS hard, lower({collapse('cleaned')}) AS x FROM keys),
    verdicts AS (SELECT *, CASE WHEN hard IS NOT NULL THEN 'REJECTED' WHEN {any_of('x', MARKERS['promotional'] + MARKERS['transactional'])} THEN 'REJECTED' WHEN {any_of('x', MARKERS['experience'] + MARKERS['comparison'])} THEN 'ACCEPTED' ELSE 'UNCERTAIN' END AS decision FROM gate)"""
CRAWL = f"""{with_views("candidates").removeprefix("WITH ")}, {GATE},
    b AS (SELECT *, run_id || '/' || path_id AS pk, (row_number() OVER (PARTITION BY run_id, path_id ORDER BY ordinal) - 1) // 20 + 1 AS batch_index,
        CASE WHEN hard IS NOT NULL THEN 0 WHEN decision = 'REJECTED' THEN 0.08 WHEN decision = 'ACCEPTED' THEN 0.86 ELSE 0.42 END AS rel, CASE WHEN hard IS NOT NULL THEN 0.99 WHEN decision = 'REJECTED' THEN 0.9 WHEN decision = 'ACCEPTED' THEN 0.82 ELSE 0.58 END AS conf FROM verdicts),
    h AS (SELECT pk AS path_id, batch_index, count(*) AS batch_size, count(*) FILTER (decision = 'ACCEPTED') AS acc, count(*) FILTER (decision = 'UNCERTAIN') AS unc, count(*) FILTER (decision = 'ACCEPTED' AND conf >= 0.75 AND rel >= conf * 0.6) AS high FROM b GROUP BY ALL),
    hd AS (SELECT *, CASE WHEN acc / batch_size >= 0.15 OR high / batch_size >= 0.05 THEN 'continue' WHEN unc / batch_size >= 0.25 THEN 'reformulate' ELSE 'weak' END AS decision FROM h)"""
CRAWL_SQL = stop_sql(CRAWL, 60) + """, done AS (SELECT path_id AS pk, batch_index, CASE WHEN stop_reason IS NOT NULL THEN 'stop' WHEN ended THEN 'reformulate' ELSE 'continue' END AS batch_decision FROM walk),
    inb AS (SELECT b.*, batch_decision, coalesce(source_url, post_id) AS dk, row_number() OVER (PARTITION BY b.pk, b.batch_index, coalesce(source_url, post_id) ORDER BY ordinal) AS rb FROM b JOIN done ON done.pk = b.pk AND done.batch_index = b.batch_index),
    inr AS (SELECT *, row_number() OVER (PARTITION BY run_id, dk ORDER BY ordinal) AS rr FROM inb WHERE rb = 1)
    SELECT run_id, path_id, ordinal, post_id, decision, CASE WHEN decision = 'REJECTED' THEN 'SCORED_REJECTED' ELSE 'CLEAN_ACCEPTED' END AS processing_stage, batch_index::INT AS batch_index, batch_decision, decision = 'REJECTED' AS is_excluded,
        CASE WHEN decision = 'REJECTED' THEN coalesce(hard, 'commercial_noise') END AS exclude_reason FROM inr WHERE source_url IS NULL OR rr = 1"""


@query(CRAWL_SQL)
def job_gate_records(spark: SparkSession, d: str) -> DataFrame:
    """The whole gate of a crawl (:mod:`hearken.plans.jobs`), one row a record that is stored."""
    from ..plans.jobs import gate_crawl

    none = F.lit(None).cast("string")
    c = candidates(spark, d).withColumns({"source_group_name": none, "parent_post_id": none, "parent_post_url": none})
    empty = F.array().cast("array<string>")
    spec = F.struct(
        F.lit("comparison").alias("research_objective"), empty.alias("target_signal_types"), empty.alias("target_author_types"), empty.alias("non_target_author_types"), empty.alias("hard_reject_signals"),
        F.struct(F.lit(8).alias("minimum_comment_text_length"), F.lit(True).alias("reject_transactional_only_comments")).alias("comment_policy"),
    )
    contexts = c.select("run_id").distinct().select("run_id", scoring.normalized_profile(scoring.lit_profile(ANCHORS, RELATED, NEGATIVE)).alias("profile"), spec.alias("spec"))
    kept, _ = gate_crawl(c, contexts, markers=MARKERS)
    return kept.select("run_id", "path_id", "ordinal", "post_id", "judge.decision", "processing_stage", "batch_index", "batch_decision", "is_excluded", "exclude_reason")
