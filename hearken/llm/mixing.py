"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source should enter the mix ``target / source_size`` times on average, at most three times.
The whole part is taken outright; the fraction is an inclusion probability. The flight phase of the cube method
moves the probabilities of a block along the null space of its two balancing constraints (words and documents)
until at most two per block are still fractional. Only those go on to the next, smaller round; a few per source
remain at the end and land on the outcome that leaves both totals nearest.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, bounded_batches, cut, text_or_empty, unused

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Decided documents that the landing may still change.
FREE = 12
#: Documents of a source that one flight handles at once.
BLOCK = 4096


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0, by code point order with null last; ranges are numbered side by side."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    parts = cut(sources.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    # one row a partition
    sizes = parts.groupBy("_p").count().withColumn("_all", F.lit(0))
    running = Window.partitionBy("_all").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_p").withColumn("place", F.col("_r") - 1 + F.col("_before")).drop("_p", "_r", "_before")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """``source, source_size, n_docs, target`` from rows with ``source`` and ``size``.

    Targets share the whole size by weight. Those above ``most`` times their source stop there and the excess is
    shared again by weight, until none is above. One aggregate of scalars per round; only rounds are counted here.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    src = cut(_ranked(sources).withColumns({"weight": w.cast("double"), "cap": (most * F.col("source_size")).cast("double")}))
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    price, held = None, -1
    while True:
        full = F.lit(False) if price is None else F.col("weight") * price >= F.col("cap")
        n_full, at_cap, open_w = src.agg(
            F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n_full == held or not open_w:
            break
        held, price = n_full, (total - at_cap) / open_w
    target = F.least(F.col("cap"), F.col("weight") * (price or 0.0))
    return src.select("source", "source_size", "n_docs", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Move ``p`` until at most two are fractional, keeping the sums of ``p`` and of ``p * size`` as they are.

    ``coin`` settles the direction of each move, so that reruns agree. Units are handled in the order given; with
    the largest first, what stays fractional at the end is small.
    """
    p = p.copy()
    live: list[int] = []
    for i in range(len(p)):
        if 1e-9 < p[i] < 1 - 1e-9:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = size[live]
        u = np.array([b - c, c - a, a - b])  # in the null space of (1, 1, 1) and of the sizes
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        q = p[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + (up if coin[i] * (up + down) < down else -down) * u  # keeps the expectation of q
        q = np.where(q < 1e-9, 0.0, np.where(q > 1 - 1e-9, 1.0, q))
        p[live] = q
        live = [j for j, x in zip(live, q, strict=True) if 0 < x < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Settle the few fractional ones, together with a dozen of the decided ones of varied size.

    Of all outcomes it takes that whose totals are nearest to the sums over ``p``, the probabilities due; ``moved``
    is what the flight left of them.
    """
    out = np.round(moved)
    open_ = np.flatnonzero((moved > 0) & (moved < 1))
    spare = np.flatnonzero(((moved == 0) | (moved == 1)) & (size > 0) & (p > 0) & (p < 1))
    spare = spare[np.unique(np.linspace(0, len(spare) - 1, min(FREE, len(spare))).astype(int))] if len(spare) else spare
    at = np.concatenate([open_, spare])
    if not len(at):
        return out
    fixed = np.ones(len(p), bool)
    fixed[at] = False
    due_w, due_n = float((p - out * fixed) @ size), float((p - out * fixed).sum())
    outcomes = np.array(list(itertools.product((0.0, 1.0), repeat=len(at))))
    cost = np.abs(outcomes @ size[at] - due_w) + 0.05 * size.mean() * np.abs(outcomes.sum(axis=1) - due_n)
    out[at] = outcomes[int(cost.argmin())]
    return out


def _round(rows: DataFrame, last: bool) -> DataFrame:
    def fly(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")
        size = g["size"].to_numpy(float)
        p = flight(g["p"].to_numpy(float), size, (g["order"].to_numpy(np.int64) % 65521) / 65521)
        return g.assign(p=landing(g["p"].to_numpy(float), size, p) if last else p)

    return rows.groupBy("source", "block").applyInPandas(fly, rows.schema)


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, order``: words of the whole text; null text has none."""
    text = text_or_empty("text")
    words = F.size(F.filter(F.split(text, WORD_BREAK), lambda w: w != ""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size")
    ).withColumn("order", F.xxhash64("doc_id", "size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """How often each document enters the mix: ``doc_id, size, source_size, target, taken, times, source``.

    Empty documents have size 0 and take 0 words; null is a source of its own, last in order; null ids are carried;
    repeated rows are documents of their own; texts may be of any length; an empty table gives no rows and columns with
    clashing names are ignored. Reruns agree: the order within a block is a hash of the document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sized = cut(sized_documents(docs))
    src = cut(targets(sized, weights, most))
    t = sized.withColumnRenamed("source", "_s").join(src, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("ratio", F.least(ratio, F.lit(float(most)))).withColumn("whole", F.floor("ratio"))
    # about BLOCK documents a block, however many a source has; empty documents move nothing
    blocks = F.ceil(F.col("n_docs") / BLOCK)
    rows = cut(
        t.withColumns({"p": F.col("ratio") - F.col("whole"), "block": F.pmod(F.col("order"), blocks)}).select(
            "source", "block", "doc_id", "size", "order", "p", "whole", "source_size", "target"
        )
    )
    settled, left = None, rows
    most_docs = src.agg(F.max("n_docs")).first()[0] or 0
    while True:
        last = most_docs <= BLOCK
        done = cut(_round(left, last))
        fixed = F.col("p").isin(0.0, 1.0)
        settled = done.filter(fixed) if settled is None else settled.unionByName(done.filter(fixed))
        if last:
            break
        # at most two of a block are left: gather a thousand blocks in one of the next round
        left = done.filter(~fixed).withColumn("block", F.floor(F.col("block") / (BLOCK // 4)))
        most_docs = 2 * -(-most_docs // BLOCK)
    times = F.col("whole") + F.col("p").cast("long")
    return settled.select(
        "doc_id", "size", F.col("source_size").cast("long"), "target", (times * F.col("size")).alias("taken"), times.alias("times"), "source"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as :func:`mix` takes it, all columns kept.

    Rows that agree in id, source and size (repeated rows, for one) share what the mix takes of them: each gets the whole
    part of it, and as many as are left over one more, so the total is that of the mix. Null ids and sources equal null
    ones; an empty table stays empty. Texts are shuffled once, to meet their counts."""
    cols, (size, n, times, k) = docs.columns, unused(docs, "_size", "_n", "_times", "_k")
    picked = mix(docs).groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"))
    picked = cut(picked.agg(F.sum("times").alias("p_sum"), F.count(F.lit(1)).alias("p_n")).filter("p_sum > 0"))
    words = F.size(F.filter(F.split(text_or_empty("text"), WORD_BREAK), lambda w: w != "")).cast("long")
    rows = docs.withColumn(size, words)

    def met(part: DataFrame) -> DataFrame:
        on = (
            rows["doc_id"].cast("long").eqNullSafe(part["p_id"])
            & rows["source"].cast("string").eqNullSafe(part["p_source"])
            & (rows[size] == part["p_size"])
        )
        return rows.join(part.hint("shuffle_hash"), on)

    taken = met(picked.filter("p_n = 1")).select(*[rows[c] for c in cols], F.col("p_sum").cast("int").alias(times))
    several = picked.filter("p_n > 1")
    if several.limit(1).count():
        # the rows of one entry are numbered over their texts' hashes: which of equal rows comes first makes no difference
        order = Window.partitionBy("p_id", "p_source", "p_size").orderBy(F.xxhash64(rows["text"].cast("string")))
        more = met(several).withColumn(n, F.row_number().over(order))
        share = F.floor(F.col("p_sum") / F.col("p_n")) + (F.col(n) <= F.col("p_sum") % F.col("p_n")).cast("int")
        taken = taken.unionByName(more.select(*[rows[c] for c in cols], share.cast("int").alias(times)))
    return taken.filter(F.col(times) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*cols)
