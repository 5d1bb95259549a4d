"""Queries of sources, sinks and the joins of small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, groups, profiles
from ..sources import sink, tables
from ..views import judged, table, with_views
from .gating import _contexts
from .labelling import GROUPS, _checkpoints
from .streams import drain_source, shared
from .text import norm

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_views("candidates", "judged") + " SELECT run_id, count(*) AS records, sum(judge_relevance_score) AS score FROM judged WHERE run_id IN ('en', 'de') GROUP BY 1")
def src_write_and_prune(spark: SparkSession, d: str) -> DataFrame:
    """Records written by run, one run overwritten by itself, and two runs read back by their partitions."""
    at = f"{shared(spark)}/posts-{uuid.uuid4().hex}"
    j = judged(spark, d)
    tables.write_by_run(j, at, "overwrite")
    tables.write_by_run(j.filter("run_id = 'de'"), at, "overwrite")
    return tables.read_table(spark, at, "crawled_posts", ["en", "de"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("records"), F.sum("judge_relevance_score").alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'phase-' || (o_orderkey % 3) ELSE 'other' END AS phase FROM orders")
def src_lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """The first non-empty of two JSON columns; broken JSON is null."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit('{"phase": "phase-'), (k % 3).cast("string"), F.lit('"}'))
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 0, "{broken").when(k % 5 == 1, "").otherwise('{"phase": "other"}').alias("a"), own.alias("b"))
    return o.select("o_orderkey", tables.lenient_json("phase string", "a", "b")["phase"].alias("phase"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'topic ' || n_regionkey END AS topic, CASE WHEN c_custkey % 7 <> 0 AND n_regionkey <> 2 THEN 'anchor ' || n_regionkey END AS anchor
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def jn_run_context(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs, nations as plans, regions as contexts; some runs have no plan, one context is broken."""
    s = lambda c: F.col(c).cast("string")
    runs = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, s("c_nationkey")).otherwise("none").alias("plan_id"))
    plans = table(spark, d, "nation").select(s("n_nationkey").alias("plan_id"), s("n_regionkey").alias("context_id"))
    profile = F.when(F.col("r_regionkey") != 2, F.concat(F.lit('{"anchors": ["anchor '), s("r_regionkey"), F.lit('"]}'))).otherwise("{")
    contexts = table(spark, d, "region").select(s("r_regionkey").alias("context_id"), F.concat(F.lit("topic "), s("r_regionkey")).alias("topic"), profile.alias("retrieval_profile_json"), F.lit(None).cast("string").alias("validity_spec_json"))
    return profiles.contexts_of_runs(runs, plans, contexts).select("c_custkey", "topic", F.element_at("profile.anchors", 1).alias("anchor"))


@query(with_views("candidates", "judged") + f" SELECT ordinal, ordinal % 3 <> 2 AND (coalesce(judge_decision, '') = 'UNCERTAIN' OR length({norm('content')}) < 24) AS wanted FROM judged")
def gt_image_fallback(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("ordinal") % 3, F.lit(None).cast("string")
    urls = F.when(k == 0, F.array(F.lit("https://cdn.example/x"))).otherwise(F.array().cast("array<string>"))
    decision = F.coalesce("judge_decision", F.lit(""))
    return judged(spark, d).select("ordinal", gates.wants_image_text("content", decision, urls, F.when(k == 1, "alt"), none, none, F.array(F.lit("pain_point"))).alias("wanted"))


@query(f"WITH {GROUPS}, f AS (SELECT run_id, gid, min(k) AS pos FROM g WHERE k % 3 = 0 GROUP BY ALL) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS ordinal, gid AS group_id FROM f")
def jn_requested_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.requested_groups(_checkpoints(spark, d))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN true ELSE false END AS enabled FROM supplier")
def pr_source_filter(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    wish = F.when(F.col("s_suppkey") % 3 == 0, "Real End-User talk").otherwise("anything")
    spec = F.struct(none.alias("target_author_types"), none.alias("non_target_author_types"), F.array(F.lit("seller")).alias("hard_reject_signals"), none.alias("target_signal_types"), wish.alias("research_objective"))
    return table(spark, d, "supplier").select("s_suppkey", gates.source_filter_enabled(spec).alias("enabled"))


WORDS_OF = """t AS (SELECT source, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[\\s.,]+'), lambda x: x <> ''))) AS word FROM documents), n AS (SELECT source, word, count(*) AS c FROM t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, word) AS rn FROM n), w AS (SELECT source AS context_id, list(word ORDER BY rn) AS ws FROM r WHERE rn <= 32 GROUP BY 1), k AS (SELECT *, array_to_string(ws[1:2], ' ') AS topic FROM w)"""


def _json(c: str) -> str:
    return f"replace(to_json({c})::VARCHAR, '\",\"', '\", \"')"


_KEYWORDS = " || ', ' || ".join(f"""'"{n}": ' || {_json(f"ws[{a}:{a + 5}]")}""" for n, a in (("behavior", 21), ("brand", 3), ("comparison", 27), ("pain_points", 9), ("sentiment", 15)))
_CONTRACT = f"""'{{"clarification_history": [], "hard_reject_signals": null, "keywords": {{' || {_KEYWORDS} || '}}, "must_have_signals": null, "plan_intent": "", "research_objective": "o", "retrieval_profile": {{}}, "target_signal_types": ["pain"], "topic": ' || to_json(topic) || '}}'"""


@query(f"WITH {WORDS_OF}, v AS (SELECT *, substr(sha256({_CONTRACT}), 1, 10) AS v, trim(regexp_replace({norm("translate(topic, 'đĐ', 'dD')")}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM k)" + """
    SELECT context_id, 'spec-' || coalesce(nullif(slug, ''), 'research') || '-' || v AS spec_id, 'phase8-v1-' || v AS spec_version, 'o' AS research_objective, 0.15::DOUBLE AS min_accept_ratio, 8 AS minimum_comment_text_length FROM v""")
def pr_validity_specs(spark: SparkSession, d: str) -> DataFrame:
    """Specs of contexts, normalized, with the digest of their contracts."""
    empty = F.from_json(F.lit("{}"), profiles.SPEC_JSON)
    fallback = F.from_json(F.lit('{"research_objective": "o", "target_signal_types": ["pain"], "comment_policy": {"minimum_comment_text_length": 8}, "batch_policy": {"min_accept_ratio": 0.15, "min_high_conf_accept_ratio": 0.05, "max_consecutive_weak_batches": 2, "uncertain_reformulation_floor": 0.25}}'), profiles.SPEC_JSON)
    c = _contexts(spark, d).select("context_id", "topic", "keywords", empty.alias("spec"), fallback.alias("fallback"))
    n = profiles.normalize_validity_spec(c, keywords=F.col("keywords"))
    return n.select("context_id", "spec.spec_id", "spec.spec_version", "spec.research_objective", "spec.batch_policy.min_accept_ratio", "spec.comment_policy.minimum_comment_text_length")


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE n_name END AS topic, n_regionkey::BIGINT AS most FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def src_cases(spark: SparkSession, d: str) -> DataFrame:
    """Files of cases, one document a nation: suppliers with a topic of their own or the nation's."""
    at = f"{shared(spark)}/cases-{uuid.uuid4().hex}"
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    case = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("topic"))
    docs = j.groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.collect_list(case).alias("cases"))
    doc = F.to_json(F.struct(F.struct(F.col("n_name").alias("topic"), F.col("n_regionkey").alias("most")).alias("defaults"), "cases"))
    docs.select(doc.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(at)
    return tables.read_cases(spark, at, {"topic": "string", "most": "long"}).select("id", "topic", "most")


@query(with_views("candidates", "judged") + " SELECT run_id, count(*) AS records, count(judge_decision) + CASE WHEN run_id = 'de' THEN 1000 ELSE 0 END AS judged FROM judged GROUP BY run_id")
def src_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Analyses written per run; that of one run is written again, the others keep theirs."""
    at = f"{shared(spark)}/analyses-{uuid.uuid4().hex}"
    a = judged(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("records"), F.count("judge_decision").alias("judged"))
    tables.write_analysis(a, at)
    tables.write_analysis(a.filter("run_id = 'de'").withColumn("judged", F.col("judged") + 1000), at)
    return tables.read_analysis(spark, at, "records long, judged long").select("run_id", "records", "judged")


@query("SELECT lang AS run_id, count(*) AS records, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def src_stream_sink(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream into folders by run; the query is started twice, the second time with nothing new."""
    at = f"{shared(spark)}/sink-{uuid.uuid4().hex}"
    docs = drain_source(spark, d, "documents").select(F.col("lang").alias("run_id"), "doc_id")
    for _ in range(2):
        sink.stream_by_run(docs, f"{at}/out", "documents", f"{at}/state").awaitTermination()
    kept = spark.read.schema("doc_id long, run_id string").parquet(f"{at}/out")
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("records"), F.sum("doc_id").alias("ids"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN (props->>'k')::BIGINT + 1000 ELSE (props->>'k')::BIGINT END AS k FROM events")
def src_lenient_props(spark: SparkSession, d: str) -> DataFrame:
    """The properties of events from the first non-empty of two columns; those of errors are broken, views have others in front."""
    e = table(spark, d, "events")
    other = F.concat(F.lit('{"k": 1'), F.lpad(F.regexp_extract("props", r"(\d+)", 1), 3, "0"), F.lit("}"))
    own = F.when(F.col("event_type") == "view", other).when(F.col("event_type") == "click", "  ")
    return e.select("event_id", own.alias("a"), F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props")).otherwise(F.col("props")).alias("b")).select("event_id", tables.lenient_json("k long", "a", "b")["k"].alias("k"))


@query("""WITH c AS (SELECT lang AS context_id, min(text) AS topic FROM documents GROUP BY 1), p AS (SELECT source AS plan_id, min(lang) AS context_id FROM documents GROUP BY 1),
    a AS (SELECT *, list_filter(string_split(regexp_replace(topic, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM c)
    SELECT doc_id, md5(topic) AS topic, CASE WHEN len(topic) % 2 = 0 THEN ws[1] END AS anchor, CASE WHEN len(topic) % 2 = 0 THEN len(ws) END AS anchors FROM documents LEFT JOIN p ON plan_id = source LEFT JOIN a USING (context_id)""")
def jn_run_context_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as runs, sources as plans, languages as contexts: the topic is a text, the profile's anchors its words; half of the profiles are broken JSON."""
    docs = table(spark, d, "documents")
    plans = docs.groupBy(F.col("source").alias("plan_id")).agg(F.min("lang").alias("context_id"))
    words = F.filter(F.split(F.regexp_replace("topic", r"\s+", " "), " "), lambda w: w != "")
    json = F.to_json(F.struct(words.alias("anchors")))
    contexts = docs.groupBy(F.col("lang").alias("context_id")).agg(F.min("text").alias("topic"))
    contexts = contexts.select("context_id", "topic", F.when(F.length("topic") % 2 == 0, json).otherwise(F.concat(F.lit("{"), json)).alias("retrieval_profile_json"), F.lit("").alias("validity_spec_json"))
    out = profiles.contexts_of_runs(docs.select("doc_id", F.col("source").alias("plan_id")), plans, contexts)
    return out.select("doc_id", F.md5("topic").alias("topic"), F.element_at("profile.anchors", 1).alias("anchor"), F.when(F.col("profile.anchors").isNotNull(), F.size("profile.anchors").cast("long")).alias("anchors"))
