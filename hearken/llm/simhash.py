"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct 64-bit fingerprints are cut into partitions of correlated bits. Two fingerprints within 3 bits agree to
within ``t_i`` bits on some partition ``i`` whenever the ``t_i + 1`` sum to 4; a dynamic program picks the unequal
thresholds with the fewest estimated candidates from exact histograms of the partitions. Buckets that are too full
are split once more by the pigeonhole over the remaining bits, then into pairs of blocks. Tasks verify all pairs of
a bucket and send on a spanning forest of the links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import components, forest, join_hubs

SEED = 42
SHINGLE = 3
DISTANCE = 3
PARTS, WIDTH = 4, 16
#: A bucket with more rows than this is split.
BUCKET = 2048
#: Keys of full buckets that are broadcast; more meet the rows by a shuffle.
BROADCAST_KEYS = 1 << 18
#: Cost of sending one probe, in candidate pairs.
PROBE_COST = 20.0


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: a bit is 1 if set in over half of them."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the hashes of the shingles; no words: 0. White space and case as stated."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at \\x20 and \\x09-\\x0D only
    n = max(len(words) - shingle + 1, min(len(words), 1))
    if not n:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    counts, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        part = range(at, min(n, at + (1 << 16)))
        h = np.fromiter((h64(joined[starts[k] : ends[k]], SEED) for k in part), np.uint64, len(part))
        counts += bit_counts(h)
    return majority(counts, n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row's whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py() or b"", shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def bit_groups(fps: DataFrame) -> list[list[int]]:
    """Partitions of the 64 bits, correlated bits together: sums of bit products over all fingerprints, then greedy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for b in batches:
            h = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            x = np.ones((len(h), 65), np.float32)
            x[:, :64] = np.unpackbits(h, axis=1, bitorder="little")
            for at in range(0, len(x), 1 << 16):
                total += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], ["k", "s"])

    sums = np.zeros(65 * 65)
    for k, s in fps.select("fp").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():  # 4225 rows
        sums[k] = s
    m = sums.reshape(65, 65)
    n = max(m[64, 64], 1.0)
    p = m[:64, 64] / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((m[:64, :64] / n - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(64)), []
    for _ in range(PARTS):
        group = [max(left, key=lambda b: (abs(p[b] - 0.5), -b))]
        left.remove(group[0])
        while len(group) < WIDTH:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def _take(fp, bits: list[int]):
    """The value of some bits of a fingerprint, as a column of longs."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def near_counts(c: np.ndarray, most: int) -> list[np.ndarray]:
    """For a histogram by value: how many lie at exactly 0, 1, ... ``most`` differing bits from each value."""
    w, v = WIDTH, np.arange(len(c))
    ring = lambda x: sum(x[v ^ (1 << b)] for b in range(w))
    out = [c.astype(float)]
    for d in range(1, most + 1):
        out.append((ring(out[-1]) - ((w - d + 2) * out[-2] if d > 1 else 0)) / d)
    return out


def thresholds(hist: list[np.ndarray], distance: int = DISTANCE) -> list[int]:
    """Thresholds, -1 for none, that sum to ``distance - parts + 1`` with the least estimated cost (dynamic program)."""
    best = {0: (0.0, [])}
    for c in hist:
        near, n = near_counts(c, distance), c.sum()
        cost, variants = [], 0
        for t in range(distance + 1):
            variants += len(list(combinations(range(WIDTH), t)))
            cost.append(float((c * sum(near[: t + 1])).sum()) / 2 + PROBE_COST * n * variants)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, ts) in best.items():
            for t in range(-1, distance + 1):
                k = used + t + 1
                x = (so_far + (cost[t] if t >= 0 else 0.0), [*ts, t])
                if k <= distance + 1 and (k not in step or x < step[k]):
                    step[k] = x
        best = step
    return best[distance + 1][1]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def bucket_links(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each run of equal ``key``; rows sorted by key. Two probes aren't compared."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    got: list[tuple[np.ndarray, np.ndarray]] = []
    held, at, d = 0, np.arange(len(key)), 1
    while len(at := at[end[at] > at + d]):
        near = (_popcount(fp[at] ^ fp[at + d]) <= distance) & ~(probe[at] & probe[at + d]) & (fp[at] != fp[at + d])
        hit = at[near]
        if len(hit):
            got.append((fp[hit], fp[hit + d]))
            held += len(hit)
            if held > 1 << 20:
                got = [forest(*(np.concatenate(x) for x in zip(*got, strict=True)))]
                held = 0
        d += 1
    if not got:
        return fp[:0], fp[:0]
    return forest(*(np.concatenate(x) for x in zip(*got, strict=True)))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: a forest with the components of all pairs of distinct ``fp`` within ``distance`` (3 at most) bits."""
    groups = bit_groups(fps)
    spark = fps.sparkSession
    values = F.array(*[F.struct(F.lit(i).alias("i"), _take(F.col("fp"), g).alias("v")) for i, g in enumerate(groups)])
    each = cut(fps.select("fp", F.explode(values).alias("p")).select("fp", "p.i", "p.v"))  # else each part below repeats the bits in its plan
    hist = [np.zeros(1 << WIDTH) for _ in groups]
    counts = each.groupBy("i", "v").count().toArrow()  # at most PARTS * 2 ** WIDTH rows, as columns
    part, value, n = (counts.column(k).to_numpy() for k in range(3))
    for i in range(len(groups)):
        hist[i][value[part == i]] = n[part == i]
    ts = thresholds(hist, distance)
    rows = None
    for i, t in enumerate(ts):
        if t < 0:
            continue
        masks = [sum(1 << b for b in x) for d in range(1, t + 1) for x in combinations(range(WIDTH), d)]
        own = each.filter(F.col("i") == i)
        tag = lambda v, i=i: F.lit(i << WIDTH).cast("long").bitwiseOR(v)
        part = own.select(tag(F.col("v")).alias("key"), F.lit(False).alias("probe"), "fp")
        if masks:
            probes = own.withColumn("x", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
            probes = probes.withColumn("w", F.col("v").bitwiseXOR(F.col("x"))).filter("w > v")  # each pair from one side
            part = part.unionByName(probes.select(tag(F.col("w")).alias("key"), F.lit(True).alias("probe"), "fp"))
        rows = part if rows is None else rows.unionByName(part)

    # too full: once more by the pigeonhole over the bits outside the partition
    full = lambda r: r.groupBy("key").count().filter(F.col("count") > BUCKET)
    rest = [[b for g in groups if g is not own for b in g] for own in groups]
    cut_n = distance + 1
    sub = None
    for i, bits in enumerate(rest):
        size = -(-len(bits) // cut_n)
        keys = F.array(*[F.xxhash64("key", F.lit(j), _take(F.col("fp"), bits[j * size : (j + 1) * size])) for j in range(cut_n)])
        sub = F.when(F.shiftright("key", WIDTH) == i, keys) if sub is None else sub.when(F.shiftright("key", WIDTH) == i, keys)
    rows = rows.join(F.broadcast(full(rows)), "key", "left")  # at most PARTS * 2 ** WIDTH keys
    rows = rows.withColumn("key", F.explode(F.when(F.col("count").isNull(), F.array("key")).otherwise(sub))).drop("count")
    # still too full: pairs of blocks, each pair a bucket; all pairs of such a bucket are compared, none but links are sent
    still = cut(full(rows))
    rows = rows.join(F.broadcast(still) if still.count() <= BROADCAST_KEYS else still, "key", "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / BUCKET))
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: F.xxhash64("key", F.least(o, own), F.greatest(o, own))
    )
    rows = rows.withColumn("key", F.explode(F.when(F.col("n") == 1, F.array("key")).otherwise(pair))).select("key", "probe", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def work(parts: list[list[np.ndarray]], whole: bool):
            key, probe, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            upto = len(key) if whole else int(np.searchsorted(key, key[-1]))
            a, b = bucket_links(key[:upto], probe[:upto], fp[:upto], distance)
            return [[key[upto:], probe[upto:], fp[upto:]]], pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        n = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= 1 << 18:
                held, out = work(held, False)
                n = len(held[0][0])
                yield out
        if held:
            yield work(held, True)[1]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id, fp`` of each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``distance`` differing bits. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows share their fingerprint; null ids
    are carried and never the smallest. Texts may be of any length. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, distance))
    rooted = cut(
        fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(join_hubs(rooted, least, "root").select("fp", "component_id"))
    return join_hubs(rows, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that have their component's smallest ``doc_id``; all columns kept.

    A component of which every id is null keeps its rows. An id that occurs in several rows stays as often.
    """
    out = near_groups(docs, shingle, distance)
    stay = out.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    cols = docs.columns
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_id"]), "left_semi").select(*cols)
