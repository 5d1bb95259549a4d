"""Upserts over Parquet files: rows by bucket of their key, where only touched buckets are written anew and swapped in by renaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import current_labels
from .files import Store

BUCKETS = 64


def _finish(store: Store, path: str) -> None:
    """End a swap that was begun: what was written whole goes in, what wasn't goes away. Doing it again changes nothing."""
    for name in store.names(path):
        if name.startswith("_swap-"):
            staged = f"{path}/{name}"
            if store.exists(f"{staged}/_SUCCESS"):
                for bucket in store.names(staged):
                    if bucket.startswith("bucket="):
                        store.delete(f"{path}/{bucket}")
                        store.move(f"{staged}/{bucket}", f"{path}/{bucket}")
            store.delete(staged)


def upsert(changes: DataFrame, path: str, key: str, merge: Callable[[DataFrame], DataFrame], row_id: Sequence[str], buckets: int = BUCKETS) -> None:
    """Put ``changes`` into the table at ``path``: rows of equal ``row_id`` replace those stored, then ``merge`` sees all rows of a key.

    Buckets (by a hash of ``key``) without changes keep their files. The new files of the others are written whole beside the table,
    then each bucket is swapped by a rename; a call that finds a swap begun ends it first, so a lost driver leaves a whole
    table after the next call, and the same changes may come again. One writer at a time. A reader may miss a bucket between the deletion
    of its old files and the rename; where that matters, read a table that isn't being written. A DataFrame of the table has to be made anew after an upsert. Renames in object stores copy.
    """
    spark = changes.sparkSession
    store = Store(spark, path)
    _finish(store, path)
    kept = [n for n in store.names(path) if n.startswith("_buckets-")]
    if kept and kept != [f"_buckets-{buckets}"]:
        raise ValueError(f"the table at {path} has other buckets: {kept[0]}, not {buckets}")
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    new = changes.withColumn("bucket", bucket)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    there = [b for b in touched if store.exists(f"{path}/bucket={b}")]
    if there:
        old = spark.read.schema(new.schema).option("basePath", path).parquet(*[f"{path}/bucket={b}" for b in there])
        ids = new.select(*row_id).distinct()
        new = old.join(ids, list(row_id), "left_anti").select(*new.columns).unionByName(new)
    staged = f"{path}/_swap-{uuid.uuid4().hex}"
    merge(new).repartition(len(touched) or 1, "bucket").write.partitionBy("bucket").parquet(staged)
    if not store.exists(f"{staged}/_SUCCESS"):
        store.touch(f"{staged}/_SUCCESS")
    if not kept:
        store.touch(f"{path}/_buckets-{buckets}")
    _finish(store, path)


def upsert_labels(labels: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Labels into the table of all labels: a label id comes once, and ``is_current`` is the newest of each record (ties to the larger id)."""
    once = labels.drop("is_current").groupBy("label_id").agg(F.max_by(F.struct(*[c for c in labels.columns if c not in ("label_id", "is_current")]), F.struct("created_at", "post_id")).alias("l")).select("label_id", "l.*")
    upsert(once.withColumn("is_current", F.lit(False)), path, "post_id", current_labels, ["label_id"], buckets)
