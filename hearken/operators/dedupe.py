"""Keep-first deduplication, new against stored, and identifiers that collide across runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_key(url: str = "source_url", post_id: str = "post_id") -> Column:
    """A record's address, or its id where it has none; so records without an address don't pile up on one key."""
    return F.coalesce(F.nullif(F.col(url), F.lit("")), F.col(post_id))


def mark_duplicates(records: DataFrame, run: str, batch: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``key``, ``dup_in_batch`` and ``dup_in_run``. First within a batch, by key; then not before in the run, by address.

    Records without an address are compared within their batch only. Of records with one key and one ``order`` in a batch the first is any one, in several batches that of the
    smallest batch.
    Firsts are least orders, which combine before the shuffle, so that many copies of an address are one row a task; records are
    joined with them, and a frequent address is a skewed join, which Spark splits.
    """
    r = records.withColumns({"key": dedupe_key(), "_has": F.coalesce("source_url", F.lit("")) != "", "_o": F.struct(*order)})
    own = [run, *batch]
    firsts = r.groupBy(*own, "key").agg(F.min("_o").alias("_first"), F.min_by("_has", "_o").alias("_url"))
    # among a batch's firsts, the earliest batch of a run keeps an address
    earliest = firsts.filter("_url").groupBy(run, "key").agg(F.min(F.struct("_first", *batch)).alias("_run_first"))
    firsts = firsts.join(earliest.select(F.col(run).alias("_e_run"), F.col("key").alias("_e_key"), "_run_first"), F.col(run).eqNullSafe(F.col("_e_run")) & F.col("key").eqNullSafe(F.col("_e_key")), "left")
    firsts = firsts.select(*[F.col(c).alias(f"_f_{c}") for c in [*own, "key"]], "_first", "_run_first")
    on = None
    for c in [*own, "key"]:
        same = r[c].eqNullSafe(firsts[f"_f_{c}"])
        on = same if on is None else on & same
    again = F.col("_o") != F.col("_first")
    if not r.groupBy(*own, "key", "_o").count().filter("count > 1").isEmpty():  # rows of one order: only then are they told apart by a window
        again = again | (F.row_number().over(Window.partitionBy(*own, "key", "_o").orderBy(F.lit(0))) > 1)
    marked = r.join(firsts, on).withColumn("dup_in_batch", again)
    in_run = ~F.col("dup_in_batch") & F.col("_has") & (F.struct(F.col("_o").alias("_first"), *batch) != F.col("_run_first"))
    return marked.withColumn("dup_in_run", F.coalesce(in_run, F.lit(False))).select(*records.columns, "key", "dup_in_batch", "dup_in_run")


def keep_first(records: DataFrame, run: str, batch: Sequence[str], order: Sequence[str]) -> DataFrame:
    return mark_duplicates(records, run, batch, order).filter(~F.col("dup_in_batch") & ~F.col("dup_in_run")).drop("key", "dup_in_batch", "dup_in_run")


def dedupe_counters(marked: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many were inserted, and how many were duplicates of which kind."""
    return marked.groupBy(*by).agg(
        F.count_if(~F.col("dup_in_batch") & ~F.col("dup_in_run")).alias("inserted"),
        F.count_if("dup_in_batch").alias("duplicate_in_batch"),
        F.count_if("dup_in_run").alias("duplicate_in_run"),
    )


def new_only(incoming: DataFrame, stored: DataFrame, run: str = "run_id") -> DataFrame:
    """Incoming records whose address isn't stored in their run (anti join; records without an address always pass)."""
    known = stored.filter(F.coalesce("source_url", F.lit("")) != "").select(F.col(run).alias("_r"), F.col("source_url").alias("_u")).distinct()
    return incoming.join(known, (F.col(run) == F.col("_r")) & (F.col("source_url") == F.col("_u")), "left_anti")


def known_ids(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming records whose id is stored already, in whatever run (semi join)."""
    return incoming.join(stored.select("post_id").distinct(), "post_id", "left_semi")


def rename_collisions(incoming: DataFrame, stored: DataFrame, order: Sequence[str]) -> DataFrame:
    """Give records a ``post_id`` of their own where theirs is taken; parents follow.

    A taken id gets ``--`` and the first ten characters of the run (without ``run-``), then ``-1``, ``-2`` … in order.
    ``original_post_id`` keeps what came in. Parents are found by address first (stored, then incoming), then by the id
    that an incoming record had in the same run.
    """
    taken = stored.select(F.col("post_id").alias("original_post_id"), F.lit(True).alias("_taken")).distinct()
    r = incoming.withColumnRenamed("post_id", "original_post_id").join(taken, "original_post_id", "left")
    suffix = F.substring(F.regexp_replace("run_id", "^run-", ""), 1, 10)
    r = r.withColumn("_base", F.concat("original_post_id", F.lit("--"), suffix))
    # how many of this run's names for the id are stored already
    names = stored.select(F.regexp_extract("post_id", r"^(.*--.{1,10}?)(?:-\d+)?$", 1).alias("_base")).filter("_base <> ''").groupBy("_base").agg(F.count(F.lit(1)).alias("_have"))
    r = r.join(names, "_base", "left")
    w = Window.partitionBy("run_id", "original_post_id").orderBy(*order)
    # the first of an id keeps it unless it is stored; the others, and all of a stored id, are renamed in order
    place = F.row_number().over(w) - F.when(F.col("_taken"), 1).otherwise(2)
    k = place + F.coalesce("_have", F.lit(0))
    renamed = F.when(k == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), k.cast("string")))
    r = r.withColumn("post_id", F.when(place < 0, F.col("original_post_id")).otherwise(renamed))
    by_id = r.groupBy(F.col("run_id").alias("_r"), F.col("original_post_id").alias("_p")).agg(F.max_by("post_id", F.struct(*order)).alias("_alias"))
    urls = r.select("run_id", "source_url", "post_id").unionByName(stored.select("run_id", "source_url", "post_id"))
    by_url = urls.filter("source_url <> ''").groupBy(F.col("run_id").alias("_ru"), F.col("source_url").alias("_u")).agg(F.min("post_id").alias("_by_url"))
    out = r.join(by_id, (F.col("run_id") == F.col("_r")) & (F.col("parent_post_id") == F.col("_p")), "left").join(
        by_url, (F.col("run_id") == F.col("_ru")) & (F.col("parent_post_url") == F.col("_u")), "left"
    )
    parent = F.coalesce("_by_url", "_alias", "parent_post_id")
    return out.withColumn("parent_post_id", parent).select("post_id", "original_post_id", *[c for c in incoming.columns if c != "post_id"])


def ordered_union(parts: Sequence[DataFrame], key: Sequence[str], value: str, order: str = "ordinal") -> DataFrame:
    """Values of several tables one after another, without repeats: the first place of each counts."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select(*key, value, F.struct(F.lit(i).alias("part"), F.col(order).cast("long").alias("at")).alias("_at"))
        rows = p if rows is None else rows.unionByName(p)
    firsts = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*key, value).agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_at", value))
    return firsts.withColumn("ordinal", place).select(*key, "ordinal", value)


def top_k_first_seen(rows: DataFrame, key: Sequence[str], value: str, order: str, k: int) -> DataFrame:
    """The ``k`` most common values of each key, ties to the one seen first: ``key…, value, count, rank``."""
    n = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("count"), "_at", value))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_at")
