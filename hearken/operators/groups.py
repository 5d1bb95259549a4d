"""Groups and posts that one step of a run hands to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def comment_tasks(posts: DataFrame, estimated: int = 30, balanced: bool = False) -> DataFrame:
    """Posts whose comments are to be read: with an address and a status that allows it; each address once, in order; each
    with its share of the run's budget. ``posts``: ``run_id, ordinal, post_id, post_url, pre_ai_status``."""
    allowed = ("ACCEPTED", "UNCERTAIN") if balanced else ("ACCEPTED",)
    ok = posts.filter((F.coalesce("post_url", F.lit("")) != "") & (F.col("pre_ai_status").isNull() | F.col("pre_ai_status").isin(*allowed)))
    first = F.row_number().over(Window.partitionBy("run_id", "post_url").orderBy("ordinal", "post_id"))
    once = ok.withColumn("_n", first).filter("_n = 1").drop("_n")
    n = once.groupBy("run_id").agg(F.count(F.lit(1)).alias("_tasks"))
    return once.join(n, "run_id").withColumn("budget", F.greatest(F.lit(1), F.floor(F.lit(estimated) / F.col("_tasks")))).drop("_tasks")


def resolve_groups(checkpoints: DataFrame) -> DataFrame:
    """Groups that later steps may search, keep-first in order: ``run_id, ordinal, group_id``.

    ``checkpoints``: ``run_id, step_order, accepted_group_ids, discovered_groups, approved_group_ids``; a discovered group
    counts if it can be read or has been joined.
    """
    open_ = F.filter("discovered_groups", lambda g: (F.coalesce(g["group_id"], F.lit("")) != "") & (F.coalesce(g["can_access"], F.lit(False)) | F.coalesce(g["status"].isin("approved", "already_member"), F.lit(False))))
    return _first_seen(checkpoints, [F.col("accepted_group_ids"), F.transform(open_, lambda g: g["group_id"]), F.col("approved_group_ids")])


def private_groups(checkpoints: DataFrame) -> DataFrame:
    """Private groups among those listed or discovered, keep-first in order."""
    ids = lambda c: F.transform(F.filter(c, lambda g: g["privacy"] == "PRIVATE"), lambda g: g["group_id"])
    return _first_seen(checkpoints, [ids("groups"), ids("discovered_groups")])


def requested_groups(checkpoints: DataFrame) -> DataFrame:
    """Groups that were asked to join: those requested, else private ones listed, else private ones not joined yet."""
    has = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    private = lambda c: F.filter(c, lambda g: g["privacy"] == "PRIVATE")
    waiting = F.filter(private("discovered_groups"), lambda g: g["status"].isin("pending", "not_joined"))
    ids = lambda a: F.transform(a, lambda g: g["group_id"])
    return _first_seen(checkpoints, [F.when(has("requested_group_ids"), F.col("requested_group_ids")).when(has("groups"), ids(private("groups"))).otherwise(ids(waiting))])


def _first_seen(checkpoints: DataFrame, lists) -> DataFrame:
    empty = F.array().cast("array<string>")

    def placed(part: int, values):
        return F.transform(F.coalesce(values, empty), lambda g, at: F.struct(F.lit(part).alias("part"), at.alias("at"), g.alias("group_id")))

    each = F.concat(*[placed(i, x) for i, x in enumerate(lists)])
    rows = checkpoints.select("run_id", "step_order", F.explode(each).alias("e")).select("run_id", "e.group_id", F.struct("step_order", "e.part", "e.at").alias("_at"))
    once = rows.filter(F.coalesce("group_id", F.lit("")) != "").groupBy("run_id", "group_id").agg(F.min("_at").alias("_at"))
    return once.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("_at", "group_id")).alias("ordinal"), "group_id")


def last_previews(records: DataFrame, path: list[str], order: list[str], kept: int = 3, chars: int = 180) -> DataFrame:
    """The last records collected on each path, with their place and a preview.

    Only the last ones of each path are sorted (ranks up to ``kept`` are cut before the shuffle); the place is the path's number of
    records less those behind."""
    from ..functions.images import has_visual
    from ..functions.text import preview

    desc = Window.partitionBy(*path).orderBy(*[F.desc(c) for c in order])
    last = records.withColumn("_back", F.row_number().over(desc)).filter(F.col("_back") <= kept)
    sizes = records.groupBy(*[F.col(c).alias(f"_p_{c}") for c in path]).agg(F.count(F.lit(1)).alias("_n"))
    on = None
    for c in path:
        same = last[c].eqNullSafe(sizes[f"_p_{c}"])
        on = same if on is None else on & same
    r = last.join(sizes, on).withColumn("position", (F.col("_n") - F.col("_back") + 1).cast("int"))
    cols = set(records.columns)
    pick = lambda n, kind="string": F.col(n) if n in cols else F.lit(None).cast(kind)
    seen = has_visual(pick("image_urls", "array<string>"), pick("image_alt_text"), pick("image_summary"))
    return r.select(*path, "position", "post_id", preview("content", chars).alias("content_preview"), seen.alias("has_image_context"))
