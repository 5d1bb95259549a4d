"""Nearest neighbours by inner product: inverted lists with an adaptive scan of rotated dimensions.

Vectors get one more component so that the largest inner product becomes the smallest distance, and are rotated at
random. Coarse centres are fitted on a bounded sample, of which some rows are held out to settle the number of probes; every row is assigned to its list, every query probes the nearest
lists. Inside a list the rotated vectors stand in blocks of columns. After each block a hypothesis test on the partial
distance drops candidates that are unlikely to come under the query's distance to beat, so most rows are never read
to the end. Lists and their queries are dealt in blocks of bounded size, whatever their number. What survives is scored
again in double precision on the original vectors. The distance to beat is the k-th one among the sample: no nearer k
rows can be missed by it, and few rows beyond the result pass it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, stored

NEIGHBOURS = 20
#: Rows that the centres are fitted on, at most; rows of a list that one task scans at once, and queries.
SAMPLE, ROWS, QUERIES = 20_000, 4096, 2048
#: Queries of the sample that settle how many lists are probed, and the share of their neighbours there to be found.
TRIED, REACHED = 512, 0.96
#: Rows a list should have on average, and rows of the sample that a centre is fitted on at least: the latter bounds the lists.
LIST_ROWS, FIT_ROWS = 1024, 30
#: One of so many rows of the sample is held out of the fit; the number of probes is settled on these.
HELD = 4
COLUMNS = 16
#: The test's margin: larger drops less.
MARGIN = 2.1
SEED = 20240229


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(col, n: int) -> np.ndarray:
    return np.array(col, np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds on a sample, from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_centres(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centres(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 2048):
        d = (c * c).sum(1)[None, :] - 2 * x[at : at + 2048] @ c.T
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out[at : at + 2048] = part
    return out


def lists_to_probe(raw: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many lists hold ``REACHED`` of the true neighbours of some rows among ``rows`` (brute force), which the centres weren't fitted on."""
    if len(raw) < 2:
        return len(centres)
    home = nearest_centres(rows, centres, 1)[:, 0]
    ranks = []
    for at in range(0, len(own), 64):
        o = own[at : at + 64]
        near = raw[o] @ raw.T
        near[np.arange(len(o)), o] = -np.inf
        top = np.argpartition(-near, min(k, len(raw) - 1) - 1, axis=1)[:, : min(k, len(raw) - 1)]
        far = (centres * centres).sum(1)[None, :] - 2 * queries[at : at + 64] @ centres.T
        place = far.argsort(axis=1).argsort(axis=1)
        ranks.append(np.take_along_axis(place, home[top], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), REACHED, method="higher")) + 1


def sample_bounds(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest of the sample (indices, -1 for none) and the ``k``-th distance: no row beyond it
    can be among the nearest of all."""
    out, top = np.full(len(queries), np.inf), np.full((len(queries), k), -1)
    norms, m = (rows * rows).sum(1), min(k, len(rows))
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        d = norms[None, :] - 2 * q @ rows.T + (q * q).sum(1)[:, None]
        d[own[at : at + 128, None] == ids[None, :]] = np.inf
        best = np.argpartition(d, m - 1, axis=1)[:, :m]
        far = np.take_along_axis(d, best, axis=1)
        top[at : at + 128, :m] = np.where(np.isfinite(far), best, -1)
        if m == k:
            out[at : at + 128] = far.max(axis=1)
    return out * (1 + 1e-9) + 1e-9, top


def scan(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int, margin: float = MARGIN):
    """For each query the nearest of ``rows`` (both rotated; rows by rising id) within its bound, without its own id, and
    what ties with the ``k``-th: (query, row) indices."""
    n, dim = rows.shape
    edges = [*range(0, dim, COLUMNS), dim]
    blocks = [np.ascontiguousarray(rows[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    norms = [(b * b).sum(1) for b in blocks]
    out_q, out_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, q in enumerate(queries):
        live, part = np.arange(n), np.zeros(n)
        for b, (block, norm) in enumerate(zip(blocks, norms, strict=True)):
            qb = q[edges[b] : edges[b + 1]]
            part = part + (norm[live] - 2 * (block[live] if len(live) < n else block) @ qb + qb @ qb)
            seen = edges[b + 1]
            # under the null hypothesis (the row is near) the partial distance is about seen / dim of it
            stay = part <= bounds[i] * ((seen / dim) * (1 + margin / np.sqrt(seen)) ** 2 if seen < dim else 1.0)
            live, part = live[stay], part[stay]
            if not len(live):
                break
        other = ids[live] != own[i]
        live, part = live[other], part[other]
        if len(live) > k:
            last = np.partition(part, k - 1)[k - 1]
            slack = 1e-9 * (1 + last)
            # those that are nearer, and of those at the k-th distance the smallest ids
            live = np.concatenate([live[part < last - slack], live[np.abs(part - last) <= slack][:k]])
        out_q.append(np.full(len(live), i))
        out_r.append(live)
    return np.concatenate(out_q), np.concatenate(out_r)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part: no nulls, not all zero, finite throughout."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(fine & F.col("id").isNotNull())


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each id divisible by ``every``.

    Nearest first, ties to the smaller id; a query's own row is no candidate, repeated ids count once, with their
    smallest vector. Vectors that are null, zero or hold null or non-finite components take no part; those of another
    length than most are no match for the rest and are left out. Tables with fewer rows give all there are. The search
    is approximate: the tests measure its recall against brute force.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    all_ = usable(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    base = stored(all_.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    sizes = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("m")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    dim, n, longest = sizes
    base = base.filter(F.col("dim") == dim)
    share = min(1.0, SAMPLE / n)
    # a bounded sample by hash: the same rows in every run
    taken = base.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("id")).limit(SAMPLE).select("id", "v", "norm").toPandas()
    turn = rotation(dim + 1)

    def rotated(v: np.ndarray, norm: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(longest**2 - norm**2, 0))
        return np.hstack([v, extra[:, None]]) @ turn

    sample = rotated(_matrix(taken["v"].tolist(), len(taken)), taken["norm"].to_numpy(), False)
    raw = _matrix(taken["v"].tolist(), len(taken))
    held = np.arange(len(sample)) % HELD == HELD - 1
    centres = fit_centres(sample[~held], max(1, min(n // LIST_ROWS, int((~held).sum()) // FIT_ROWS)))
    tried = np.unique(np.linspace(0, max(int(held.sum()) - 1, 0), min(TRIED, int(held.sum()))).astype(int))
    probes = lists_to_probe(raw[held], sample[held], rotated(raw[held][tried], np.zeros(len(tried)), True), tried, centres, k)

    sample_ids = taken["id"].to_numpy()

    def assign(count: int, query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = rotated(v, b.column(2).to_numpy(zero_copy_only=False), query)
                near = nearest_centres(x, centres, count)
                lists_ = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, count, dtype=np.int32)), pa.array(near.ravel()))
                own = b.column(0).to_numpy(zero_copy_only=False)
                bound, top = sample_bounds(x, own, sample, sample_ids, k) if query else (np.zeros(len(x)), np.zeros((len(x), 0), int))
                seen = [
                    [{"vec_id": int(sample_ids[j]), "score": float(np.einsum("i,i->", v[i], raw[j]))} for j in row if j >= 0] for i, row in enumerate(top)
                ]
                seen = pa.array(seen, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*b.columns, lists_, pa.array(bound), seen], ["id", "v", "norm", "lists", "bound", "seen"])

        return run

    kinds = "id long, v array<double>, norm double, lists array<long>, bound double, seen array<struct<vec_id:long,score:double>>"
    rows = base.select("id", "v", "norm").mapInArrow(assign(1, False), kinds).withColumn("list", F.element_at("lists", 1)).drop("lists", "seen")
    rows = stored(rows, "rows")
    asked = base.filter(F.col("id") % every == 0).select("id", "v", "norm").mapInArrow(assign(probes, True), kinds)
    queries = stored(asked, "queries")
    asked = queries.withColumn("list", F.explode("lists")).drop("lists", "seen")
    # one row a list: into how many blocks its rows and its queries are cut
    plan = cut(
        rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("r"))
        .join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("q")), "list")
    )
    deal = lambda part, own, other: (
        part.join(plan, "list")
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col(own)))
        .withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    )
    left = deal(rows, "r", "q").select("list", F.col("mine").alias("a"), F.col("theirs").alias("b"), "id", "v", "norm")
    right = deal(asked, "q", "r").select("list", F.col("theirs").alias("a"), F.col("mine").alias("b"), "id", "v", "norm", "bound")

    def block(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        r, q = r.sort_values("id"), q.sort_values("id")
        rv, qv = _matrix(r["v"].tolist(), len(r)), _matrix(q["v"].tolist(), len(q))
        ids, own = r["id"].to_numpy(), q["id"].to_numpy()
        i, j = scan(rotated(rv, r["norm"].to_numpy(), False), ids, rotated(qv, q["norm"].to_numpy(), True), own, q["bound"].to_numpy(), k)
        score = np.einsum("ij,ij->i", qv[i], rv[j])
        d = pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": score})
        return d.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    key = ["list", "a", "b"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, "query_id long, vec_id long, score double")
    known = queries.select(F.col("id").alias("query_id"), F.explode("seen").alias("s")).select("query_id", "s.vec_id", "s.score")
    found = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
