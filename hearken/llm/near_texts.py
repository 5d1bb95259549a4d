"""Near copies by SimHash and the exact similarity of their shingles: the verified mode of near-duplicate removal.

Fingerprints of the sets of shingles are linked by the generalised pigeonhole (:mod:`.simhash`); each text of such a group is
compared with the group's first one on the whole sets. A fingerprint can't tell all pairs: at a similarity of 0.8 about 10 of its 64
bits differ. So a prefix filter finds the links between what is still apart, and only that.

Two sets of shingles with a Jaccard similarity of 0.8 or more share one of the first fifth of each, in any order that holds
for all. In the order taken here shingles that are frequent in the whole table come last, so texts that only share a common
passage don't meet. In each key's bucket all texts are compared with its first one; then, of what those links leave apart,
every pair of similar size and near sketches, in tasks that send on a forest of the links. All links are verified on the whole sets (those with a first one
only if sketches of 96 min-hashes agree). So a large group of near copies mostly costs one comparison a text and key, and
pairs within a bucket are never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scratch, stored, text_or_empty, without
from .components import HUBS, components, few, join_hubs, meet_least
from .simhash import bit_counts, forest, links as near_fingerprints, majority
from .superkmers import COUNTERS, HEAVY, LEAST_PLACES, demoted, frequent_grams

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
#: Min-hashes of a sketch, and how many of them agree at least. Two sets at 0.8 agree in fewer with a probability of 2e-7.
SKETCH, AGREE = 96, 56
#: Bytes of shingles of a bucket that one task compares with one another; larger buckets are cut into blocks of so many.
BLOCK_BYTES = 4 << 20
#: Sketches of a bucket that one task compares; as above.
BLOCK = 4096
#: A text in more than 1/CENTRES of all pairs meets them in so many parts.
CENTRES, SALTS = 4096, 64
_A, _X = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SKETCH, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; all words are one if they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length).tolist(), ends[min(size, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((h64(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends)))


def sketch(h: np.ndarray) -> bytes:
    """One byte of each min-hash."""
    least = np.full(SKETCH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, ((h[k : k + 4096] ^ _X) * _A).min(axis=1))
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def first_ones(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set has one among its own first ones."""
    p = len(h) - int(np.ceil(SIMILARITY * len(h) - 1e-9)) + 1 if len(h) else 0
    order = np.argsort(demoted(h, frequent), kind="stable")
    return h[order[:p]].view(np.int64)


def _name(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``SIMILARITY`` or more."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def may_agree(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles with sketches ``x`` and ``y`` may be similar."""
    return (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)) & ((x == y).sum(axis=-1) >= AGREE)


def _with_both(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (name, ...) for both, as ``x_`` and ``y_``. A name in many pairs is dealt out."""
    n = pairs.count()
    hot = pairs.groupBy("a").count().filter(F.col("count") > max(256, n // CENTRES)).select(F.col("a").alias("name"), F.lit(True).alias("hot"))
    hot = cut(few(hot, HUBS))
    salted = table.join(F.broadcast(hot), "name", "left")
    salted = salted.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    left = salted.select(F.col("name").alias("a"), "salt", *[F.col(c).alias(f"x_{c}") for c in cols])
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = pairs.join(F.broadcast(hot.withColumnRenamed("name", "a")), "a", "left").withColumn("salt", salt)
    right = table.select(F.col("name").alias("b"), *[F.col(c).alias(f"y_{c}") for c in cols])
    return dealt.join(right, "b").join(left, ["a", "salt"]).select("a", "b", *[f"x_{c}" for c in cols], *[f"y_{c}" for c in cols])


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (3, 5))
            yield b.select(["a", "b"]).filter(pa.array(may_agree(n, m, x, y)))

    rows = _with_both(pairs, sketches, "n", "sketch").select("a", "b", "x_n", "x_sketch", "y_n", "y_sketch")
    return cut(rows.mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return cut(_with_both(pairs, sets, "hashes").mapInArrow(run, "a long, b long"))


def linked(key: np.ndarray, name: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between names of different roots within runs of equal ``key``, by exact similarity.

    Of each text the shingles that it shares with every other one are counted over lists of the texts that hold a shingle."""
    if not len(key):
        return name[:0], name[:0]
    got = [(name[:0], name[:0])]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist(), strict=True):
        if (root[i:j] == root[i]).all():
            continue
        n = np.array([len(s) for s in sets[i:j]])
        flat = np.concatenate(sets[i:j])
        order = np.argsort(flat, kind="stable")
        holder = np.repeat(np.arange(j - i), n)[order]
        fresh = np.append(True, flat[order][1:] != flat[order][:-1])
        group = np.cumsum(fresh) - 1
        begin = np.append(np.flatnonzero(fresh), len(flat))
        where = np.empty(len(flat), np.int64)
        where[order] = group
        at, own, label = 0, name[i:j], root[i:j].copy()  # what is linked by now has one label, so at most j - i links are held
        for k in range(j - i):
            g = where[at : at + n[k]]
            at += n[k]
            size = begin[g + 1] - begin[g]
            g, size = g[size > 1], size[size > 1]
            if not len(g):
                continue
            place = np.repeat(begin[g] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            both = np.bincount(holder[place], minlength=j - i)[:k]
            hit = np.flatnonzero((both >= SIMILARITY * (n[:k] + n[k] - both)) & (label[:k] != label[k]))
            if len(hit):
                old, one = np.unique(label[hit], return_index=True)
                got.append((own[hit[one]], np.full(len(one), own[k])))
                label[np.isin(label, old)] = label[k]
    return forest(*(np.concatenate(x) for x in zip(*got, strict=True)))


def agreeing(key: np.ndarray, name: np.ndarray, root: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs of equal ``key`` and different roots that may be similar by their sizes and sketches."""
    got = [(name[:0], name[:0])]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
    for i, j in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        order = i + np.argsort(n[i:j], kind="stable")  # by size: what may be similar to one stands next to it
        size = n[order]
        upto = np.searchsorted(size, size / SIMILARITY + 1e-9, side="right")
        # what is linked by now has one label and isn't compared again, so at most j - i links are held; texts of one root get
        # no common label, as those of another root may be similar to either
        label, own = np.arange(len(order)), root[order]
        for k, o in enumerate(order.tolist()):
            others = k + 1 + np.flatnonzero((own[k + 1 : upto[k]] != own[k]) & (label[k + 1 : upto[k]] != label[k]))
            if len(others):
                hit = others[(x[order[others]] == x[o]).sum(axis=1) >= AGREE]
                if len(hit):
                    old, one = np.unique(label[hit], return_index=True)
                    got.append((name[order[hit[one]]], np.full(len(one), name[o])))
                    label[np.isin(label, old)] = label[k]
    return forest(*(np.concatenate(c) for c in zip(*got, strict=True)))


def _in_buckets(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """``rows`` by their key, sorted; keys of more than ``limit`` weight are cut into blocks, each two of which have a key."""
    sizes = cut(rows.groupBy("key").agg(F.ceil(F.sum(weight) / limit).alias("blocks")).filter("blocks > 1"))
    sizes = F.broadcast(sizes) if sizes.count() <= 1 << 16 else sizes
    dealt = rows.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("blocks"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(o, own), F.greatest(o, own)))
    dealt = dealt.withColumn("key", F.explode(F.when(F.col("blocks") == 1, F.array("key")).otherwise(each))).select(*rows.columns)
    return dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")


def _whole_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows in tables of about ``size`` bytes that hold all rows of a key (the first column)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            upto = int(np.searchsorted(key, key[-1]))
            if upto:
                yield t.slice(0, upto)
            held = [pa.RecordBatch.from_pylist(t.slice(upto).to_pylist(), t.schema)]  # a copy: the rest isn't held
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _simhash_links(named: DataFrame, sets_of) -> DataFrame:
    """Links ``a, b`` of names (name, fp): in each group of near fingerprints, its least name and those that are similar to it."""
    groups = components(near_fingerprints(cut(named.select("fp").distinct())))
    rows = named.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("a"), F.col("name").alias("b"))
    rows = cut(rows)
    pairs = cut(meet_least(rows, rows.count(), F.min("b")).filter("m <> b").select(F.col("m").alias("a"), "b"))
    return _verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("name"))))


def _apart_links(apart: DataFrame, sketches: DataFrame, sets_of) -> DataFrame:
    """Links ``a, b`` between rows (key, name, root) with one key and different roots; tasks send forests of links, no pairs.

    Keys are first told apart by size, so that only sizes that may be similar meet; then sketches name what may be similar."""
    grade = F.floor(F.log("n") / float(-np.log(SIMILARITY)) + 1e-9)
    graded = apart.join(sketches, "name").withColumn("key", F.explode(F.array(*[F.xxhash64("key", grade + k) for k in (0, 1)])))
    graded = stored(graded, "graded")
    several = graded.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key")
    rows = graded.join(several, "key", "left_semi").select("key", "name", "root", "n", "sketch")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches, BLOCK_BYTES):
            key, root, n = (t.column(k).to_numpy() for k in (0, 2, 3))
            x = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH)
            a, b = agreeing(key, t.column(1).to_numpy(), root, n, x)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches, BLOCK_BYTES):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column(3)]
            a, b = linked(*(t.column(k).to_numpy() for k in range(3)), sets)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # what may be linked lies in one component of what may be similar: each is one more bucket, and a text is in one of them
    open_ = components(_in_buckets(rows, F.lit(1), BLOCK).mapInArrow(near, "a long, b long"))
    roots = graded.select("name", "root").distinct()
    held = open_.select(F.col("root").alias("key"), F.col("node").alias("name")).join(roots, "name").join(sets_of(open_.select(F.col("node").alias("name"))), "name")
    held = held.select("key", "name", "root", "hashes")
    return cut(_in_buckets(held, F.octet_length("hashes"), BLOCK_BYTES).mapInArrow(link, "a long, b long").distinct())


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id``: the smallest ``doc_id`` reachable over pairs of similar texts, for each row of ``docs``.

    Case (of A-Z) and white space don't count. Null and empty texts are equal to each other and similar to no other; a text
    under five words is one shingle. Texts may be of any length. Repeated rows and ids that several rows share are carried;
    null ids are carried and never the smallest. Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    all_shingles = lambda ts: np.concatenate([np.zeros(0, np.uint64), *map(shingles, ts)])
    frequent = frequent_grams(texts, all_shingles, HEAVY, LEAST_PLACES, COUNTERS)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [shingles(x.as_py()) for x in b.column(1)]
            keys = pa.array([first_ones(h, frequent) for h in hs], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in hs], pa.int64())
            fps = pa.array(np.array([majority(bit_counts(h), len(h)) for h in hs], np.uint64).view(np.int64))
            cols = [b.column(0), pa.array(map(_name, hs), pa.int64()), sizes, pa.array(map(sketch, hs), pa.binary()), fps, keys]
            yield pa.RecordBatch.from_arrays(cols, names_)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [shingles(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(h) for h in hs], pa.int64()), pa.array([h.tobytes() for h in hs], pa.binary())], ["name", "hashes"])

    def sets_of(used: DataFrame) -> DataFrame:
        """``name, hashes`` of the names ``used``: the shingles of one text of each."""
        ids = cut(rows.join(used.distinct(), "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("_id")).select("_id").distinct())
        ids = F.broadcast(ids) if ids.count() <= 1 << 20 else ids
        sets = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text").mapInArrow(hashed, "name long, hashes binary")
        return stored(sets.dropDuplicates(["name"]), "sets")

    names_ = ["doc_id", "name", "n", "sketch", "fp", "keys"]
    rows = stored(texts.mapInArrow(named, "doc_id long, name long, n long, sketch binary, fp long, keys array<long>"), "shingled")
    names = rows.groupBy("name").agg(F.min("doc_id").alias("first"))
    sketches = rows.dropDuplicates(["name"]).select("name", "n", "sketch")
    by_simhash = _simhash_links(rows.select("name", "fp").distinct(), sets_of)
    by_simhash = few(by_simhash, by_simhash.count())
    # what a group of near fingerprints has joined isn't compared again: keys that only such texts have are left out
    joined = by_simhash.select(F.col("b").alias("name"), F.col("a").alias("root"))  # a name is in one group
    keyed = rows.dropDuplicates(["name"]).select("keys", "name").join(joined, "name", "left")
    keyed = keyed.select(F.explode("keys").alias("a"), F.col("name").alias("b"), F.coalesce("root", "name").alias("root"))
    several = keyed.groupBy("a").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("a")
    keyed = stored(keyed.join(several, "a", "left_semi"), "keyed")
    stars = meet_least(keyed, keyed.count(), F.min(F.struct("b", "root"))).filter("m.root <> root")
    stars = cut(stars.select(F.col("m.b").alias("a"), "b").distinct())
    near = _sketched(stars, sketches)
    links = _verified(near, sets_of(near.select(F.explode(F.array("a", "b")).alias("name")))).unionByName(by_simhash)
    links = few(links, links.count())
    roots = components(links)
    # of what is still apart in a bucket, every pair
    apart = keyed.select(F.col("a").alias("key"), F.col("b").alias("name")).join(roots.withColumnRenamed("node", "name"), "name", "left")
    apart = apart.select("key", "name", F.coalesce("root", "name").alias("root"))
    whole = F.bit_xor(F.xxhash64("name"))
    open_keys = apart.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("c"), whole.alias("w"))
    # a pair alone was compared with its first one; of keys with the same texts one is enough
    open_keys = open_keys.filter("r1 <> r2 AND c > 2").groupBy("c", "w").agg(F.min("key").alias("key")).select("key")
    apart = stored(apart.join(open_keys, "key", "left_semi"), "apart")
    links = links.unionByName(_apart_links(apart, sketches, sets_of))
    links = few(links, links.count())
    rooted = cut(names.join(components(links).withColumnRenamed("node", "name"), "name", "left").select("name", "first", F.coalesce("root", "name").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = cut(join_hubs(rooted, least, "root").select("name", "component_id"))
    return join_hubs(rows.select("doc_id", "name"), found, "name").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have their component's smallest ``doc_id``; all columns kept.

    A component of which every id is null keeps its rows. An id that occurs in several rows stays as often, if one of them stays.
    """
    out = F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    with scratch(docs.sparkSession):
        marked = near_groups(docs).groupBy("doc_id").agg(F.min(out).alias("out")).filter("out")
        return without(docs, marked.select(F.col("doc_id").alias("_id")), {"_id": F.col("doc_id").cast("long")})
