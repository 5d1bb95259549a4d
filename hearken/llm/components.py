"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is several jobs, of which the driver keeps plans, broadcasts and statistics. So a graph of a bounded number of links gets no
rounds: tasks make spanning forests of their links, and what these leave is joined in one bounded task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fewer nodes than this are handled as hubs, whatever the size of the graph.
HUBS, LEAST_DEGREE = 4096, 256
#: Links (of 16 bytes) that one task joins; larger graphs go through rounds.
FEW_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its tree) with the same components as the links ``a - b``."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib, label = inv[: len(a)], inv[len(a) :], np.arange(len(nodes))
    while True:
        m = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, ia, m)
        np.minimum.at(new, ib, m)
        np.minimum.at(new, label[ia], m)
        np.minimum.at(new, label[ib], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's links."""
    parts = [(np.zeros(0, np.int64),) * 2, *((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)]
    a, b = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def few(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` of at most ``n_rows`` rows in no more partitions than these need, so that small graphs leave few files a round."""
    return df.coalesce(max(4, n_rows // 100_000))


def meet_least(rows: DataFrame, n_rows: int, least) -> DataFrame:
    """``rows`` with ``m``, the least neighbour of their node ``a``.

    Nodes with more than ``1 / HUBS`` of all rows are fewer than ``HUBS``: they are broadcast and their rows stay where
    they are. The rows of the others are shuffled.
    """
    stars = rows.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("_n"))
    hubs = cut(few(stars.filter(F.col("_n") > max(LEAST_DEGREE, n_rows // HUBS)).select("a", "m"), HUBS))
    at_hubs = rows.join(F.broadcast(hubs), "a")
    others = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(stars.select("a", "m"), "a")
    return at_hubs.unionByName(others)


def join_hubs(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key). Keys with more than ``1 / HUBS`` of all rows are broadcast, the others shuffled."""
    n = rows.count()
    hubs = cut(few(rows.groupBy(key).count().filter(F.col("count") > max(LEAST_DEGREE, n // HUBS)).select(key), HUBS))
    at_hubs = rows.join(F.broadcast(table.join(F.broadcast(hubs), key)), key)
    return at_hubs.unionByName(rows.join(F.broadcast(hubs), key, "left_anti").join(table, key))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = meet_least(both, 2 * n, F.least(F.col("a"), F.min("b")))
    return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = meet_least(down, n, F.min("b")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(down.groupBy("a").agg(F.min("b").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node on an edge ``a, b`` (longs); ``root`` is the component's smallest node.

    Up to ``FEW_LINKS`` links are joined without rounds. Beyond that each round is materialized in the shared folder; the loop ends
    when a round changes nothing. Self links are dropped; no edges give no rows.
    """
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    seen = mark(now)
    now = few(now, seen[0])
    rounds = seen[0] > FEW_LINKS
    if not rounds:
        now = cut(now.mapInArrow(_trees, "a long, b long").repartition(1).mapInArrow(_trees, "a long, b long"))
    while rounds:
        big = cut(few(_large_star(now, seen[0]), 2 * seen[0]))
        now = cut(few(_small_star(big, big.count()).distinct(), 2 * seen[0]))
        before, seen = seen, mark(now)
        if before == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
