"""Session helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; Python's ``bytes.split()`` splits on exactly these six bytes.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="hearken-"))
    return (path or sc.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that :func:`stored` wrote within the innermost :func:`scratch`.
_WRITTEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that :func:`stored` writes inside are deleted at the end; what is to last must have been cut or written by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _WRITTEN.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialize small intermediate rows in the shared folder; later stages don't depend on earlier executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, but as a compressed Parquet table, for larger rows."""
    path = scratch_path(df.sparkSession, name)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`stored`, for a result that outlasts the :func:`scratch` in which it is made."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch in this session, so that memory of Python workers doesn't grow with the texts. All
    operators set the same bound, so it doesn't matter which of them was built last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_tasks(spark: SparkSession, total_bytes: int, per_task: int) -> int:
    """Partitions for ``total_bytes``: at least the session's shuffle partitions, about ``per_task`` bytes each."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total_bytes) // per_task))


def dealt(df: DataFrame, total_bytes: int, *keys: str, per_task: int = 32 << 20) -> DataFrame:
    """``df`` dealt out by ``keys`` to the session's shuffle partitions, or to more if ``total_bytes`` needs them."""
    n = n_tasks(df.sparkSession, total_bytes, per_task)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def text_or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


#: Keys of rows to drop that are broadcast; more meet the table by a shuffle.
DROPPED = 1 << 19


def without(df: DataFrame, losers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (expressions by the names of ``losers``' columns) are not among ``losers``.

    Few losers are broadcast and ``df`` isn't shuffled; their number is counted first. Null keys equal null ones."""
    losers = cut(losers.distinct())
    few = losers.count() <= DROPPED
    names = unused(df, *keys)
    gone = losers.toDF(*[f"{n}_gone" for n in names]) if losers.columns == [*keys] else losers.select(*keys).toDF(*[f"{n}_gone" for n in names])
    marked = df.withColumns(dict(zip(names, keys.values(), strict=True)))
    on = None
    for n in names:
        same = marked[n].eqNullSafe(gone[f"{n}_gone"])
        on = same if on is None else on & same
    return marked.join(F.broadcast(gone) if few else gone, on, "left_anti").select(*[marked[c] for c in df.columns])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
