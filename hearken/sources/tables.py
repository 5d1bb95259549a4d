"""Reading and writing the tables: explicit schemas, lenient JSON columns, files of cases, dynamic overwrite, streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.closeout import CHECKPOINT

SCHEMAS = {
    "crawled_posts": (
        "post_id string, run_id string, step_run_id string, group_id_hash string, content string, content_masked string, record_type string, source_url string, parent_post_id string, "
        "parent_post_url string, posted_at timestamp, reaction_count int, comment_count int, processing_stage string, pre_ai_status string, pre_ai_score double, pre_ai_reason string, judge_decision string, "
        "judge_relevance_score double, judge_confidence_score double, judge_reason_codes array<string>, judge_used_image_understanding boolean, judge_image_summary string, "
        "score_breakdown struct<anchor_score:double,related_score:double,quality_score:double,source_score:double,parent_context_score:double,negative_penalty:double>, quality_flags array<string>, "
        "query_family string, source_type string, source_batch_index int, batch_decision string, provider_used string, fallback_used boolean, label_status string, current_label_id string, is_excluded boolean, "
        "exclude_reason string, crawled_at timestamp"
    ),
    "content_labels": (
        "label_id string, post_id string, run_id string, label_job_id string, taxonomy_version string, author_role string, content_intent string, commerciality_level string, user_feedback_relevance string, "
        "label_confidence double, label_reason string, label_source string, model_name string, model_version string, is_current boolean, created_at timestamp"
    ),
    "label_jobs": "label_job_id string, run_id string, taxonomy_version string, status string, records_total long, records_labeled long, records_fallback long, records_failed long, started_at timestamp, ended_at timestamp",
    "theme_results": "theme_id string, run_id string, label string, dominant_sentiment string, post_count long, sample_quotes array<string>",
    "plan_runs": "run_id string, plan_id string, status string, completion_reason string, failure_class string, answer_status string, started_at string, ended_at string, total_records long",
    "step_runs": "step_run_id string, run_id string, step_id string, status string, actual_count int, started_at string, ended_at string, error_message string, checkpoint string, checkpoint_json string",
    "plans": "plan_id string, context_id string",
    "plan_steps": "plan_id string, step_id string, step_order int, action_type string, read_or_write string, target string, estimated_count int, estimated_duration_sec int, dependency_step_ids string",
    "product_contexts": "context_id string, topic string, keyword_json string, retrieval_profile_json string, validity_spec_json string",
    "account_health_log": "log_id string, account string, signal_type string, status_before string, status_after string, detected_at timestamp, cooldown_until timestamp",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def read_table(spark: SparkSession, path: str, table: str, runs: Sequence[str] | None = None) -> DataFrame:
    """A table's Parquet files with its fixed schema, pruned to some runs if given (its partitions are runs)."""
    df = spark.read.schema(schema_of(table)).parquet(path)
    return df.filter(F.col("run_id").isin(*runs)) if runs else df


def read_sql(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, runs: Sequence[str] | None = None, **options: str) -> DataFrame:
    """A table behind an SQL address, read in ``parts`` ranges of ``column`` (a number, date or time).

    The ranges come from the column's extremes among the wanted rows, which the database finds; ``runs`` go to the database as a condition.
    The driver class comes with ``options``. An empty table, or one whose column is null throughout, is read as one part.
    """
    whole = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        quoted = ", ".join("'" + run.replace("'", "''") + "'" for run in runs or ())
        extremes = f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}" + (f" WHERE run_id IN ({quoted})" if quoted else "")
        low, high = spark.read.format("jdbc").options(url=url, query=extremes, **options).load().first()
        if low is not None:
            whole = whole.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    df = whole.load()
    name = next((c for c in df.columns if c.lower() == "run_id"), None)
    return df.filter(F.col(name).isin(*runs)) if runs else df


def lenient_json(schema: str | T.StructType, *columns: str) -> Column:
    """The first non-empty of some JSON text columns as a struct; broken JSON is null."""
    return F.from_json(F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns]), schema, {"mode": "PERMISSIVE"})


def with_checkpoint(step_runs: DataFrame) -> DataFrame:
    """``checkpoint`` as a struct, from either of its columns."""
    return step_runs.withColumn("checkpoint", lenient_json(CHECKPOINT, "checkpoint", "checkpoint_json")).drop("checkpoint_json")


def read_cases(spark: SparkSession, path: str, fields: dict[str, str], ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Cases of files with one JSON document each (``defaults`` and ``cases``): a case's own value, else the default."""
    case = T.StructType.fromDDL(", ".join(["id string", *[f"{k} {v}" for k, v in fields.items()]]))
    doc = T.StructType([T.StructField("defaults", case), T.StructField("cases", T.ArrayType(case))])
    raw = spark.read.schema(doc).json(path, multiLine=True)
    each = raw.select("defaults", F.posexplode("cases").alias("position", "c"))
    out = each.select(F.col("c.id").alias("id"), "position", *[F.coalesce(F.col(f"c.{k}"), F.col(f"defaults.{k}")).alias(k) for k in fields])
    if ids is not None:
        out = out.filter(F.col("id").isin(*ids))
    return out.orderBy("position", "id").limit(limit) if limit is not None else out


def write_by_run(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows into partitions by run. ``mode="overwrite"`` replaces just the runs that occur (delete by run, then insert)."""
    df.write.mode(mode).partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_analysis(df: DataFrame, path: str) -> None:
    """One JSON document a run, in the run's folder; runs that aren't in ``df`` keep theirs."""
    df.repartition("run_id").write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").json(path)


def read_analysis(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of :func:`write_analysis`, with ``run_id`` from their folders."""
    return spark.read.schema(f"{schema}, run_id string").json(path)


def stream_table(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int | None = None, format: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.format(format).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)
