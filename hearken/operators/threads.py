"""Comment threads: parents, nearest ancestors by pointer doubling, and nesting from indentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def parent_context(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Add ``parent_text`` and ``parent_status``: the parent by id within the run, else by address.

    A parent without a status counts as ACCEPTED; a comment without a parent row has neither.
    """
    status = F.coalesce(F.nullif(F.col("judge_decision"), F.lit("")), F.nullif(F.col("pre_ai_status"), F.lit("")), F.lit("ACCEPTED"))
    row = F.struct(F.coalesce(F.nullif(F.col("content_masked"), F.lit("")), F.col("content")).alias("text"), status.alias("status"))
    by_id = posts.groupBy(F.col("run_id").alias("_r1"), F.col("post_id").alias("_id")).agg(F.min(row).alias("_p1"))
    by_url = posts.filter("source_url <> ''").groupBy(F.col("run_id").alias("_r2"), F.col("source_url").alias("_url")).agg(F.min(row).alias("_p2"))
    out = comments.join(by_id, (F.col("run_id") == F.col("_r1")) & (F.col("parent_post_id") == F.col("_id")), "left")
    out = out.join(by_url, (F.col("run_id") == F.col("_r2")) & (F.col("parent_post_url") == F.col("_url")), "left")
    p = F.coalesce("_p1", "_p2")
    return out.withColumns({"parent_text": p["text"], "parent_status": p["status"]}).select(*comments.columns, "parent_text", "parent_status")


def thread_context(records: DataFrame) -> DataFrame:
    """Add ``parent_post_summary``, ``parent_comment_summary`` and ``thread_context`` to comments; posts have none.

    The walk goes up the parents that are in ``records``, to the nearest comment with text and to the post at the root;
    it ends where a parent is missing or comes back, at any depth. Hops double with each join until no row moves or, where
    parents come back, there are as many as the largest run has records. Only ids and short summaries move, and each round
    is cut from its lineage.
    """
    summary = F.substring(F.coalesce(F.nullif(F.col("content_masked"), F.lit("")), F.col("content"), F.lit("")), 1, 240)
    nodes = records.groupBy("run_id", "post_id").agg(
        F.min(F.struct(F.coalesce("record_type", F.lit("POST")).alias("kind"), summary.alias("text"), F.nullif(F.col("parent_post_id"), F.lit("")).alias("parent"))).alias("n")
    )
    # from each node upwards: the nearest comment's text and the nearest post's, counting the node itself
    comment = F.when((F.col("n.kind") == "COMMENT") & (F.col("n.text") != ""), F.col("n.text"))
    post = F.when(F.col("n.kind") == "POST", F.col("n.text"))
    at_post = F.col("n.kind") == "POST"
    up = nodes.select(
        "run_id", "post_id", comment.alias("c"), post.alias("p"), at_post.alias("done"), F.when(~at_post, F.col("n.parent")).alias("next")
    )
    hops, up = 1, cut(up)
    most = up.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    while hops < most and up.filter("next is not null").limit(1).count():
        far = up.select(F.col("run_id").alias("_r"), F.col("post_id").alias("_i"), *[F.col(x).alias(f"_{x}") for x in ("c", "p", "done", "next")])
        j = up.join(far, (F.col("run_id") == F.col("_r")) & (F.col("next") == F.col("_i")), "left")
        up = j.select(
            "run_id", "post_id", F.coalesce("c", "_c").alias("c"), F.coalesce("p", "_p").alias("p"),
            (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done"),
            F.when(~F.col("done") & ~F.coalesce("_done", F.lit(True)), F.col("_next")).alias("next"),
        )
        hops, up = hops * 2, cut(up)
    a = up.select(F.col("run_id").alias("_r"), F.col("post_id").alias("_i"), F.nullif(F.col("c"), F.lit("")).alias("_c"), F.nullif(F.col("p"), F.lit("")).alias("_p"))
    out = records.join(a, (F.col("run_id") == F.col("_r")) & (F.col("parent_post_id") == F.col("_i")) & (F.col("record_type") == "COMMENT"), "left")
    parts = F.concat_ws("\n", F.concat(F.lit("Parent post: "), F.col("_p")), F.concat(F.lit("Parent comment: "), F.col("_c")))
    return out.withColumns(
        {"parent_post_summary": F.col("_p"), "parent_comment_summary": F.col("_c"), "thread_context": F.nullif(parts, F.lit(""))}
    ).select(*records.columns, "parent_post_summary", "parent_comment_summary", "thread_context")


def nest_by_indent(comments: DataFrame, step: float = 18.0, same: float = 8.0) -> DataFrame:
    """``post, ordinal, parent``: the comment that each one answers, or null if it answers the post.

    Indents count from that of the post's first comment, to the left of it as zero. A comment closes all open ones that it doesn't exceed by more
    than ``same``. If it exceeds the last that is still open by ``step`` or more, it answers that one and is open below it, else it answers the post and is
    the only one open. A null indent is zero. One fold over a post's comments in order; a post's comments are one array.
    """
    entry = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(F.col("indent").cast("double"), F.lit(0.0)).alias("indent"))
    posts = comments.select("post", entry.alias("c")).groupBy("post").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    pairs, links = "array<struct<ordinal:bigint,x:double>>", "array<struct<ordinal:bigint,parent:bigint>>"
    start = F.struct(F.expr(f"cast(array() as {pairs})").alias("open"), F.expr(f"cast(array() as {links})").alias("some"), F.expr(f"cast(array() as array<{links}>)").alias("full"))

    def place(s: Column, c: Column) -> Column:
        x = F.greatest(c["indent"] - F.element_at("cs", 1)["indent"], F.lit(0.0))
        still = F.filter(s["open"], lambda o: x > o["x"] + same)
        below = F.try_element_at(still, F.lit(-1))
        own = F.struct(c["ordinal"].alias("ordinal"), x.alias("x"))
        fits = F.coalesce(x >= below["x"] + step, F.lit(False))
        some = F.concat(s["some"], F.array(F.struct(c["ordinal"].alias("ordinal"), F.when(fits, below["ordinal"]).alias("parent"))))
        full = F.size(some) >= 256  # so that a long thread doesn't copy all its links for each comment
        return F.struct(
            F.when(fits, F.concat(still, F.array(own))).otherwise(F.array(own)).alias("open"),
            F.when(full, F.expr(f"cast(array() as {links})")).otherwise(some).alias("some"),
            F.when(full, F.concat(s["full"], F.array(some))).otherwise(s["full"]).alias("full"),
        )

    folded = posts.select("post", F.aggregate("cs", start, place, lambda s: F.concat(F.flatten(s["full"]), s["some"])).alias("links"))
    return folded.select("post", F.explode("links").alias("l")).select("post", "l.ordinal", "l.parent")
