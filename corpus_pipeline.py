"""A training corpus from the raw documents: the stages in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearken.llm import exact_dedup, mixing, near_texts, quality, sentencepiece_codec
from hearken.llm.common import scratch_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, columns unchanged. It is fitted on ``labels``; without labels of both
    classes all stay. A repeated id stays if any row of it is accepted; null and empty texts are judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id (null ids lose); of rows repeated with id and text, one. Null equals empty."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: texts linked by a Jaccard similarity of 0.8 or more
    of their five-word shingles, verified. SimHash fingerprints group them; a prefix filter then finds the links that fingerprints
    can't tell. Groups of null ids only stay; rows that share an id stay or go together."""
    return near_texts.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most three times; columns unchanged. Null is a source of its own."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with the text that they decode to."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_exact_copies),
    ("simhash near-dedup", no_near_copies),
    ("mixing to target weights", mixed),
    ("sentencepiece encoding", encoded),
]

#: A fitted classifier and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
