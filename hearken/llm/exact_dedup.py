"""Exact deduplication with a heavy-hitter split; DataFrame functions only.

1. One scan of the texts leaves ``(doc_id, sha256)`` rows in the shared folder; texts aren't shuffled.
2. A Misra-Gries frequent-items sketch (``approx_top_k``) names the digests that may hold more than 1/1024 of
   all rows. An exact aggregate over only these verifies them; fewer than 1024 can pass, so the winners have a
   proven bound and are broadcast. Their rows are resolved map-side and never meet in one task.
3. What remains has groups of at most 1/1024 of the rows: an ordinary shuffle on the digest, winners combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty, unused, without

#: A key counts as heavy when it holds more than 1/HEAVY of all rows.
HEAVY = 1024


def elect(rows: DataFrame, key: str, id_col: str, largest: bool) -> DataFrame:
    """Add ``keep_id``, ``keep_row`` and ``group_size``: for each row the extreme ``id_col`` among rows of equal ``key``.

    ``rows`` has the columns ``key``, ``id_col`` and a unique ``_row``, and should be materialized. Ties on
    ``id_col`` go to the extreme ``_row``. Null ids lose to all others. ``key`` must not be null.
    """
    n = rows.count()
    pick = F.max if largest else F.min
    # null ids sort first: as smallest they lose for max; for min a flag puts them last
    order = F.struct(F.col(id_col).isNotNull() if largest else F.col(id_col).isNull(), F.col(id_col), F.col("_row"))
    winner = [pick(order).alias("_w"), F.count(F.lit(1)).alias("group_size")]
    sketch = rows.agg(F.expr(f"approx_top_k({key}, {2 * HEAVY}, {8 * HEAVY})").alias("top"))
    names = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))
    heavy = cut(
        rows.join(F.broadcast(names), key, "left_semi").groupBy(key).agg(*winner).filter(F.col("group_size") * HEAVY > n)
    )
    fast = rows.join(F.broadcast(heavy), key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    slow = light.join(light.groupBy(key).agg(*winner), key)  # both sides shuffled by the key, one of them combined before
    cols = [*rows.columns, "_w", "group_size"]
    return (
        fast.select(*cols)
        .unionByName(slow.select(*cols))
        .withColumns({"keep_id": F.col(f"_w.{id_col}"), "keep_row": F.col("_w._row")})
        .drop("_w")
    )


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, sha, _row)`` of every row, materialized. Null text counts as empty."""
    return cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(text_or_empty("text").cast("binary"), 256).alias("sha"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical byte for byte; null counts as empty. Of equal texts the row with the largest
    ``doc_id`` stays; null ids lose to any other; of rows repeated with the same id and text exactly one stays.
    Texts may be of any length. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    out = elect(digests(docs), "sha", "doc_id", largest=True)
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without its exact copies, all columns kept; of rows repeated with one id and text one is left.

    Null and empty texts are copies of one another. Texts stay where they are while few rows go (see :func:`.common.without`);
    only rows whose id and text repeat are shuffled whole. An empty table stays empty."""
    cols, (id_, sha) = docs.columns, unused(docs, "_id", "_sha")
    keys = {id_: F.col("doc_id").cast("long"), sha: F.unhex(F.sha2(text_or_empty("text").cast("binary"), 256))}
    rows = exact_groups(docs).groupBy(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(sha))
    rows = cut(rows.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"))
    out = without(docs, rows.select(id_, sha), keys)
    again = rows.filter("kept").select(F.col(id_).alias("k_id"), F.col(sha).alias("k_sha"))
    if again.limit(1).count():
        marked = docs.withColumns(keys)
        on = marked[id_].eqNullSafe(again["k_id"]) & (marked[sha] == again["k_sha"])
        out = out.unionByName(marked.join(again, on, "left_semi").dropDuplicates([id_, sha]).select(*[marked[c] for c in cols]))
    return out
