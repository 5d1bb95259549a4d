"""Places of records within groups of any size: keys are sorted over ranges, and only the ranges' sizes are summed up.

A window over a group sorts all its records in one task. Here the keys of a large group are dealt over ranges like any others, and whole
records move once, to their place, by a key that is even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def first_places(records: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``group…, order…, _first, _same``: how many records of the group come before each key, plus one, and how many have the key."""
    keys = records.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_same"))
    spread = keys.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    spread = cut(spread).withColumn("_part", F.shiftright("_at", 33))
    parts = spread.groupBy(*group, "_part").agg(F.sum("_same").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("_local", F.coalesce(F.sum("_same").over(within), F.lit(0)))
    on = local["_part"] == offsets["_g_part"]
    for c in group:
        on = on & local[c].eqNullSafe(offsets[f"_g_{c}"])
    return local.join(offsets, on).select(*group, *order, (F.col("_offset") + F.col("_local") + 1).alias("_first"), "_same")


def numbered(records: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``records`` with ``name``, the place (from 1) in the group by ``order``, nulls first; records of one key are numbered in any order."""
    places = cut(first_places(records, group, order))
    ties = not places.filter("_same > 1").isEmpty()
    key = [*group, *order]
    places = places.select(*[F.col(c).alias(f"_k_{c}") for c in key], "_first")
    on = None
    for c in key:
        same = records[c].eqNullSafe(places[f"_k_{c}"])
        on = same if on is None else on & same
    out = records.join(places, on)
    place = F.col("_first")
    if ties:
        place = place + F.row_number().over(Window.partitionBy(*[f"_k_{c}" for c in key]).orderBy(F.lit(0))) - 1
    return out.select(*records.columns, place.cast("long").alias(name))
