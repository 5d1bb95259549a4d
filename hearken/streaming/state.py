"""What operators with keyed state need of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> None:
    """State of several variables a key, with timers, is kept in RocksDB; its changes go to the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
