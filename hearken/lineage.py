"""Cutting long lineages by tables in the shared folder, so that loops stay cheap and lost executors do no harm."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in ``spark.checkpoint.dir`` (a temporary folder where it is unset, as in tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="hearken-"))
    return df.checkpoint(eager=True)
