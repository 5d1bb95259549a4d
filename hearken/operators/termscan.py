"""How many terms of large lists occur in texts: one Aho-Corasick automaton per profile, each text read once.

:func:`hearken.functions.text.count_terms` looks for one term after another, which suits lists of some dozens. Here the time for a
text doesn't depend on the number of terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

LISTS = ("anchors", "related_terms", "negative_terms")
#: Bytes of all terms that are broadcast; automata that a worker keeps; records of a profile beyond which it is dealt over ``SALTS`` parts.
MOST_BYTES, KEPT, HOT, SALTS = 16 << 20, 64, 50_000, 64


class Terms:
    """Counts for several lists at once. A term that stands twice in a list counts twice, empty ones and nulls never."""

    def __init__(self, lists: Sequence[Sequence[str] | None]):
        self.weights: list[list[int]] = []
        self.width = len(lists)
        at: dict[str, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, terms in enumerate(lists):
            for t in terms if terms is not None else ():
                if t:
                    i = at.setdefault(t, len(at))
                    if i == len(self.weights):
                        self.machine.add_word(t, i)
                        self.weights.append([0] * self.width)
                    self.weights[i][k] += 1
        if at:
            self.machine.make_automaton()

    def count(self, text: str | None) -> list[int]:
        if not text or not self.weights:
            return [0] * self.width
        found = {i for _, i in self.machine.iter(text)}
        return [sum(self.weights[i][k] for i in found) for k in range(self.width)]


#: Automata of the last scan in this worker, by profile.
_BUILT: dict[str, dict[object, Terms]] = {}


def _automaton(scan: str, key, lists) -> Terms:
    if scan not in _BUILT:
        _BUILT.clear()
        _BUILT[scan] = {}
    own = _BUILT[scan]
    if key not in own:
        if len(own) >= KEPT:
            own.pop(next(iter(own)))
        own[key] = Terms(lists)
    return own[key]


def term_bytes(profiles: DataFrame, lists: Sequence[str] = LISTS) -> int:
    """Bytes of all terms of all profiles."""
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.octet_length(t), F.lit(0)) + 8), F.lit(0).cast("long"))
    return profiles.agg(F.coalesce(F.sum(sum((size(c) for c in lists), F.lit(0))), F.lit(0))).first()[0]


def scan_terms(records: DataFrame, profiles: DataFrame, on: str, text: str, lists: Sequence[str] = LISTS, out: str = "hits", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``records`` with the struct ``out``: for each list of the record's profile, how many of its terms are substrings of ``text``.

    ``profiles`` has one row per value of ``on`` and an array of terms per list. Records without a profile, null texts and null lists
    count nothing. Terms of at most ``most_bytes`` in all are broadcast and records stay where they are; more are sent to the records,
    which are dealt by profile, those of frequent profiles over many parts.
    """
    profiles = profiles.select(on, *[F.col(c).cast("array<string>").alias(c) for c in lists])
    if term_bytes(profiles, lists) <= most_bytes:
        return _with_broadcast(records, profiles, on, text, lists, out)
    return _dealt(records, profiles, on, text, lists, out)


def _with_broadcast(records: DataFrame, profiles: DataFrame, on: str, text: str, lists: Sequence[str], out: str) -> DataFrame:
    scan = uuid.uuid4().hex
    shared = records.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in profiles.collect()})

    @F.pandas_udf(", ".join(f"{c} long" for c in lists))
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, none = shared.value, [0] * len(lists)
        for keys, texts in batches:
            rows = [_automaton(scan, k, known[k]).count(t) if k in known else none for k, t in zip(keys, texts, strict=True)]
            yield pd.DataFrame(rows, columns=list(lists))

    return records.withColumn(out, count(F.col(on).cast(profiles.schema[on].dataType), F.col(text)))


def _dealt(records: DataFrame, profiles: DataFrame, on: str, text: str, lists: Sequence[str], out: str) -> DataFrame:
    sizes = records.groupBy(F.col(on).alias("_k")).count()
    n = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = sizes.filter(F.col("count") > max(HOT, n // 1024)).select("_k", F.lit(True).alias("_hot"))  # fewer than 1024
    is_hot = F.coalesce("_hot", F.lit(False))
    left = records.select(F.col(on).alias("_k"), F.col(text).alias("_text"), F.struct(*records.columns).alias("_row"), F.monotonically_increasing_id().alias("_id"))
    left = left.join(F.broadcast(hot), "_k", "left").select("_k", F.when(is_hot, F.pmod("_id", F.lit(SALTS))).otherwise(0).alias("_salt"), F.lit(1).alias("_kind"), "_row", "_text")
    right = profiles.withColumnRenamed(on, "_k").join(F.broadcast(hot), "_k", "left")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.select("_k", F.explode(salts).alias("_s"), *lists).select("_k", F.col("_s").cast("long").alias("_salt"), F.lit(0).alias("_kind"), *lists)
    rows = left.unionByName(right, allowMissingColumns=True).repartition("_k", "_salt").sortWithinPartitions("_k", "_salt", "_kind")
    schema = StructType([StructField("_row", left.schema["_row"].dataType), StructField(out, StructType([StructField(c, LongType()) for c in lists]))])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, terms = None, Terms([()] * len(lists))
        for b in batches:
            counts, kept = [], []
            columns = [b.column(c).to_pylist() for c in ("_k", "_salt", "_kind", "_text")]
            for i, (k, salt, kind, t) in enumerate(zip(*columns, strict=True)):
                if (k, salt) != key:
                    key, terms = (k, salt), Terms([b.column(c)[i].as_py() for c in lists] if kind == 0 else [()] * len(lists))
                if kind:
                    kept.append(i)
                    counts.append(dict(zip(lists, terms.count(t), strict=True)))
            row = b.column("_row").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([row.cast(arrow.field(0).type), pa.array(counts, arrow.field(1).type)], schema=arrow)

    done = rows.mapInArrow(count, schema)
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in records.columns], out)
