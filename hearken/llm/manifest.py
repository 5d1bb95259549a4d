"""Merkle manifest of a table: a digest tree per source, one over their roots, and a proof for each row, by time-forward processing.

A scan takes each row's digest; texts stay where they are. Digests are sorted by source and id over ranges, and their places are
counted from the ranges' sizes, so a source of any size is dealt evenly. Blocks of ``arity ** LEVELS`` consecutive nodes are
trees of their own, whose tops are the nodes of the next round, until every source is one block; then the sources' roots are the nodes of one more
tree. Nodes of a block are labelled by the last leaf below them, then by their level, so that each comes after its children.

* Up: leaves come in by label. A node sends its digest to its parent through a priority queue ordered by label; a parent's turn is when
  the last of its children has sent. What a parent received is written as a record.
* Down: records and leaves come in by falling label. A node takes the rest of its proof, from its level to the root, from the queue
  and sends each child the siblings in front of it. Leaves close their proofs and fold digests up to the root.

The queue keeps ``QUEUE`` entries in memory and sorted runs of the others on disk. With these labels it holds at most ``arity`` entries
a level, so it stays in memory unless the arity is very large.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dealt, lasting, n_tasks, scratch, stored

ARITY, LEVELS = 16, 3
QUEUE, RUNS = 1 << 16, 64
#: Where the unsigned crc32 of an id is divisible by this, its row counts as tampered.
TAMPERED = 5


class LabelQueue:
    """Priority queue of (label, payload); beyond ``memory`` entries as sorted runs in temporary files of the task."""

    def __init__(self, memory: int = QUEUE, runs: int = RUNS):
        self.memory, self.most, self.sent = memory, runs, 0
        self.held: list[tuple] = []
        self.runs: list[tuple] = []  # the first entry of each run, with its file

    def send(self, label: int, payload) -> None:
        heapq.heappush(self.held, (label, self.sent, payload))
        self.sent += 1
        if len(self.held) > self.memory:
            if len(self.runs) >= self.most:
                old, self.runs = self.runs, []
                self._write(heapq.merge(*(self._rest(*r) for r in old)))
            held, self.held = sorted(self.held), []
            self._write(held)

    def _write(self, entries: Iterable[tuple]) -> None:
        f = tempfile.TemporaryFile(prefix="labels-")
        for e in entries:
            pickle.dump(e, f, -1)
        f.seek(0)
        self._first(f)

    def _first(self, f) -> None:
        try:
            label, sent, payload = pickle.load(f)
        except EOFError:
            f.close()
        else:
            heapq.heappush(self.runs, (label, sent, payload, f))

    def _rest(self, label, sent, payload, f) -> Iterator[tuple]:
        yield label, sent, payload
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                f.close()
                return

    def take(self, label: int) -> list:
        """Payloads sent to ``label``, in the order in which they were sent; earlier labels must have been taken."""
        out = []
        while True:
            inside = self.held[0][:2] if self.held else None
            outside = self.runs[0][:2] if self.runs else None
            first = min(x for x in (inside, outside, (label + 1, 0)) if x is not None)
            if first[0] != label:
                return out
            if first == inside:
                out.append(heapq.heappop(self.held)[2])
            else:
                _, _, payload, f = heapq.heappop(self.runs)
                out.append(payload)
                self._first(f)


def digest_of(digests: bytes) -> bytes:
    """Digest of the hex text of digests."""
    return sha256(digests.hex().encode()).digest()


def last_below(index: int, level: int, size: int, arity: int) -> int:
    """The last leaf below a node of a block of ``size`` leaves."""
    return min((index + 1) * arity**level, size) - 1


def sweep_up(leaves: Iterable[bytes], size: int, height: int, arity: int, queue: LabelQueue) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """``(last, level, children's digests, own digest if it is the top)`` of every inner node, by label; of a lone leaf, itself."""
    for at, digest in enumerate(leaves):
        level, index = 0, at
        while True:
            if level == height:
                if not height:
                    yield at, 0, digest, digest
                break
            level, index = level + 1, index // arity
            last = last_below(index, level, size, arity)
            queue.send(last * 64 + level, digest)
            if last != at:
                break
            below = b"".join(queue.take(last * 64 + level))
            digest = digest_of(below)
            yield at, level, below, digest if level == height else None


class Proof:
    """Siblings left and right of a path, from a node up to the root, as hex text."""

    __slots__ = ("path", "text")

    def __init__(self, path: tuple[tuple[bytes, bytes], ...]):
        self.path = path
        self.text = b"".join(left + right for left, right in path)

    def below(self, left: bytes, right: bytes) -> Proof:
        out = Proof.__new__(Proof)
        out.path, out.text = ((left, right), *self.path), left + right + self.text
        return out

    def __reduce__(self):
        return Proof, (self.path,)

    def fold(self, digest: bytes) -> str:
        """The root that follows from a leaf's digest."""
        d = digest.hex()
        for left, right in self.path:
            d = sha256(left + d.encode() + right).hexdigest()
        return d


def sweep_down(nodes: Iterable[tuple[int, int, bytes]], top: Proof, arity: int, queue: LabelQueue) -> Iterator[tuple[int, Proof]]:
    """``(place, proof)`` of every leaf. ``nodes``: ``last, level, children's digests`` by falling label, leaves with level 0."""
    size = None
    for at, (last, level, below) in enumerate(nodes):
        if size is None:
            size, proof = last + 1, top
        else:
            proof = queue.take(-(last * 64 + level))[0]
        if not level:
            yield at, proof
            continue
        hexed, first = below.hex().encode(), last // arity**level * arity
        for k in range(len(below) // 32):
            child = last_below(first + k, level - 1, size, arity)
            queue.send(-(child * 64 + level - 1), proof.below(hexed[: 64 * k], hexed[64 * k + 64 :]))


# -- tables


def _field(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def row_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, g, digest, tampered, _row`` of every row: ``g`` stands for the source and sorts like it, null first; ``tampered`` is the
    digest with A-Z of the text lower-cased, of those rows that are tampered with. One scan, built-in functions only."""
    fields = {c: F.col(c).cast(kind).cast("string") for c, kind in {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}.items()}
    digest = lambda **new: F.unhex(F.sha2(F.concat(*[_field(c) for c in (fields | new).values()]).cast("binary"), 256))
    lower = F.translate(fields["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    g = F.when(fields["source"].isNull(), F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(F.lit("01")), fields["source"].cast("binary")))
    touched = F.crc32(fields["doc_id"].cast("binary")) % TAMPERED == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        g.alias("g"),
        digest().alias("digest"),
        F.when(touched, digest(text=lower)).alias("tampered"),
        F.monotonically_increasing_id().alias("_row"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the group ``g`` by ``order`` (which begins with ``g``), and ``n``, the group's rows. Groups are
    dealt over ranges; only the ranges' counts are summed up, so no group meets in one task."""
    parts = n_tasks(rows.sparkSession, rows.count() * 160, 32 << 20)
    at = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "places")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    ranges = at.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(ranges.select("g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("g")).alias("n")))
    return at.join(ranges, ["g", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before", "_row")


def _by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first two columns; each block's rows must be read before the next block."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def block(key=key) -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:2] == key:
                yield row
                row = next(rows, None)

        yield key, block()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_RECORD = "g binary, block long, last int, level int, below binary, top binary, n long"
_RECORDS = pa.schema([("g", pa.binary()), ("block", pa.int64()), ("last", pa.int32()), ("level", pa.int32()), ("below", pa.binary()), ("top", pa.binary()), ("n", pa.int64())])


#: Bytes of a node and its record, for the number of tasks.
_NODE = 160


def _up(nodes: DataFrame, total: int, arity: int) -> DataFrame:
    """Records of the inner nodes of one round of ``total`` nodes; ``n`` of a block's top is the number of blocks of its group."""
    width, memory = arity**LEVELS, QUEUE

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for (g, block), rows in _by_block(batches, ["g", "block", "n", "digest"]):
                first = next(rows)
                n, size, height = first[2], min(width, first[2] - block * width), LEVELS
                if n <= width:
                    height = 0
                    while arity**height < n:
                        height += 1
                leaves = (r[3] for part in ((first,), rows) for r in part)
                for last, level, below, top in sweep_up(leaves, size, height, arity, LabelQueue(memory)):
                    yield g, block, last, level, below, top, -(-n // width)

        yield from _batched(records(), _RECORDS)

    rows = nodes.select("g", F.floor(F.col("pos") / width).alias("block"), "pos", "n", "digest")
    return dealt(rows, total * _NODE, "g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(sweep, _RECORD)


def _down(nodes: DataFrame, records: DataFrame, incoming: DataFrame, total: int, arity: int, final: Callable[..., tuple], ddl: str, schema: pa.Schema) -> DataFrame:
    """Proofs of the nodes of one round, given those of their blocks' tops (``incoming``: ``g, block, path, subroot, root``); each leaf's
    row of the result is what ``final`` makes of the node, its proof and the roots."""
    width, memory = arity**LEVELS, QUEUE
    columns = ["g", "block", "last", "level", "below", "path", "subroot", "root", "doc_id", "tampered"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[tuple]:
            for (g, block), rows in _by_block(batches, columns):
                head = next(rows)
                top = Proof(tuple((x["left"], x["right"]) for x in head[5]))
                now: list[tuple] = []

                def nodes(rows=rows, now=now) -> Iterator[tuple[int, int, bytes]]:
                    for r in rows:
                        now[:] = [r]
                        yield r[2], r[3], r[4]

                for _, proof in sweep_down(nodes(), top, arity, LabelQueue(memory)):
                    r = now[0]
                    yield final(g, block * width + r[2], r[4], proof, head[6], head[7], r[8], r[9])

        yield from _batched(proofs(), schema)

    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    path = "array<struct<left:binary,right:binary>>"
    rest = [none("path", path), none("subroot", "string"), none("root", "string")]
    extra = [F.col(c) if c in nodes.columns else none(c, kind) for c, kind in (("doc_id", "long"), ("tampered", "binary"))]
    leaves = nodes.select("g", F.floor(F.col("pos") / width).alias("block"), (F.col("pos") % width).cast("int").alias("last"), F.lit(0).alias("level"), F.col("digest").alias("below"), *rest, *extra)
    inner = records.filter("level > 0").select("g", "block", "last", "level", "below", *rest, none("doc_id", "long"), none("tampered", "binary"))
    heads = incoming.select("g", "block", F.lit(1 << 30).alias("last"), F.lit(0).alias("level"), none("below", "binary"), F.col("path").cast(path).alias("path"), "subroot", "root", none("doc_id", "long"), none("tampered", "binary"))
    rows = dealt(leaves.unionByName(inner).unionByName(heads), 2 * total * _NODE, "g", "block")
    return rows.sortWithinPartitions("g", "block", F.desc("last"), F.desc("level")).mapInArrow(sweep, ddl)


_PATHS = "g binary, pos long, subroot string, root string, digest binary, path array<struct<left:binary,right:binary>>"
_PATH = pa.schema([("g", pa.binary()), ("pos", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("digest", pa.binary()), ("path", pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))])


def _as_path(g, pos, digest, proof: Proof, subroot, root, doc_id, tampered) -> tuple:
    return g, pos, subroot, root, digest, [{"left": a, "right": b} for a, b in proof.path]


_ROW = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
_ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


Rounds = list[tuple[DataFrame, DataFrame, int]]


def climb(nodes: DataFrame, arity: int) -> tuple[Rounds, DataFrame]:
    """The rounds (nodes, records and number of nodes of each), and ``g, digest`` of the top of every group."""
    rounds, tops, total = [], None, nodes.count()
    while True:
        records = stored(_up(nodes, total, arity), "records")
        rounds.append((nodes, records, total))
        blocks = records.filter("top is not null").select("g", F.col("block").alias("pos"), "n", F.col("top").alias("digest"))
        ended = blocks.filter("n = 1").select("g", "digest")
        tops = ended if tops is None else tops.unionByName(ended)
        nodes = blocks.filter("n > 1")
        total = nodes.count()
        if not total:
            return rounds, tops


def descend(rounds: Rounds, incoming: DataFrame, arity: int, final=_as_path, ddl: str = _PATHS, schema: pa.Schema = _PATH) -> DataFrame:
    """Proofs of the first round's nodes. ``incoming``: ``g, path, subroot, root`` of every group's top."""
    down = None
    for k in range(len(rounds) - 1, -1, -1):
        nodes, records, total = rounds[k]
        ended = records.filter("top is not null and n = 1").select("g")
        heads = incoming.join(ended, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if down is not None:
            heads = heads.unionByName(down.select("g", F.col("pos").alias("block"), "path", "subroot", "root"))
        down = stored(_down(nodes, records, heads, total, arity, _as_path, _PATHS, _PATH), "paths") if k else _down(nodes, records, heads, total, arity, final, ddl, schema)
    return down


def manifest(docs: DataFrame, arity: int = ARITY, with_proofs: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, and ``proof`` if wanted.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``, each as its length in bytes, a colon and the value, or ``-`` where
    null. Per source, leaves ascend by id (null first; of equal ids the smaller digest first), and every ``arity`` consecutive nodes become
    the digest of their hex texts, the last ones being fewer or one, until one is left, the ``subroot``. Null is a source of its own.
    Subroots in the order of sources, null first, become the ``root`` in the same way. ``proof`` has the siblings of the path, level by
    level, left to right, as hex text; ``proof_sha256`` is its digest. ``folded_root`` is folded from the tampered leaf (A-Z of the text lower-cased, where
    ``TAMPERED`` divides the id's crc32; null ids aren't tampered with), else from the leaf, and the original siblings; ``verified`` says
    whether it is the root. Repeated rows are leaves of their own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    schema, ddl = (_ROW.append(pa.field("proof", pa.string())), f"{_ROWS}, proof string") if with_proofs else (_ROW, _ROWS)

    def final(g, pos, digest, proof: Proof, subroot, root, doc_id, tampered) -> tuple:
        folded = proof.fold(tampered or digest)
        row = doc_id, digest.hex(), subroot, root, sha256(proof.text).hexdigest(), folded, folded == root
        return (*row, proof.text.decode()) if with_proofs else row

    with scratch(docs.sparkSession):
        leaves = placed(stored(row_digests(docs), "leaves"), ["g", "doc_id", "digest", "_row"])
        rounds, tops = climb(leaves, arity)
        sources = placed(cut(tops.select(F.unhex(F.lit("00")).alias("g"), F.col("g").alias("source"), "digest", F.lit(0).alias("_row"))), ["g", "source"])
        upper, top = climb(sources, arity)
        no_path = F.expr("cast(array() as array<struct<left:binary,right:binary>>)")
        paths = descend(upper, top.select("g", no_path.alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root")), arity)
        named = paths.drop("g").join(sources.select("pos", F.col("source").alias("g")), "pos")
        heads = cut(named.select("g", "path", F.lower(F.hex("digest")).alias("subroot"), "root"))
        return lasting(descend(rounds, heads, arity, final, ddl, schema), "manifest")
