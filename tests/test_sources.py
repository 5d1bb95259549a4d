"""Upserts that leave untouched files alone, a sink that takes each batch once, and reads from a database."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from hearken.sources import sink, tables, upsert
from hearken.sources.files import Store

LABEL = "label_id string, post_id string, author_role string, created_at int"


def label(post, version, role="end_user"):
    return (f"l{version}-{post}", post, role, version)


def stored(spark, path):
    return spark.read.schema("label_id string, post_id string, author_role string, created_at int, is_current boolean").parquet(path)


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_upsert_of_labels(spark, tmp_path):
    """Two rounds give what one gives, a round again changes nothing, and buckets without changes keep their files."""
    at, frame = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, LABEL)
    posts = [f"p{k}" for k in range(60)]
    upsert.upsert_labels(frame([label(p, 1) for p in posts]), at, buckets=16)
    before = files(at)
    second = frame([label("p1", 2, "seller_affiliate"), label("p1", 1, "unknown"), label("new", 1), label("new", 1)])
    for _ in range(2):
        upsert.upsert_labels(second, at, buckets=16)
    after = files(at)
    kept = [b for b in before if after[b] == before[b]]
    assert len(kept) >= len(before) - 2 and set(after) >= set(before)
    rows = {r.label_id: (r.author_role, r.is_current) for r in stored(spark, at).collect()}
    assert len(rows) == stored(spark, at).count() == 62
    assert rows["l1-p1"] == ("unknown", False) and rows["l2-p1"] == ("seller_affiliate", True) and rows["l1-new"] == ("end_user", True)
    assert not [n for n in os.listdir(at) if n.startswith("_swap")]
    with pytest.raises(ValueError):
        upsert.upsert_labels(second, at, buckets=8)
    upsert.upsert_labels(frame([]), at, buckets=16)
    assert files(at) == after


def test_upsert_goes_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    at, frame = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, LABEL)
    upsert.upsert_labels(frame([label(f"p{k}", 1) for k in range(40)]), at, buckets=8)
    moves = []

    def move(self, old, new, go=Store.move):
        if len(moves) == 3:
            raise OSError("lost")
        moves.append(new)
        go(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(Store, "move", move)
        with pytest.raises(OSError, match="lost"):
            upsert.upsert_labels(frame([label(f"p{k}", 2) for k in range(40)]), at, buckets=8)
    upsert.upsert_labels(frame([label("p0", 3)]), at, buckets=8)
    rows = stored(spark, at)
    assert rows.count() == 81 and rows.filter("is_current").count() == 40
    assert rows.filter("is_current and created_at = 2").count() == 39
    # a swap that wasn't written whole goes away
    os.makedirs(f"{at}/_swap-x/bucket=0")
    upsert.upsert_labels(frame([label("p0", 3)]), at, buckets=8)
    assert stored(spark, at).count() == 81 and not os.path.exists(f"{at}/_swap-x")


class Lost(sink.RunSink):
    """Dies before the second batch is marked, once."""

    def __init__(self, path, name):
        super().__init__(path, name)
        self.left = [2]

    def commit(self, store, mark):
        self.left[0] -= 1
        if self.left[0] == 0:
            raise OSError("killed between write and commit")
        super().commit(store, mark)


def test_sink_takes_each_batch_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = lambda k: spark.createDataFrame([(f"r{i % 3}", 100 * k + i) for i in range(20)], "run_id string, n long")
    for k in range(3):
        rows(k).coalesce(2).write.mode("append").parquet(src)
    stream = tables.stream_table(spark, src, "run_id string, n long", files_per_trigger=2)
    with pytest.raises(Exception, match="killed"):
        sink.stream_by_run(stream, out, "q", state, Lost(out, "q")).awaitTermination()
    kept = spark.read.schema("n long, run_id string").parquet(out)
    assert kept.count() > 20  # the lost batch's files are there, unmarked
    for _ in range(2):
        sink.stream_by_run(stream, out, "q", state).awaitTermination()
    got = spark.read.schema("n long, run_id string").parquet(out)
    assert sorted((r.run_id, r.n) for r in got.collect()) == sorted((f"r{i % 3}", 100 * k + i) for k in range(3) for i in range(20))
    sink.RunSink(out, "q").write(rows(9), 0)  # marked long ago
    assert got.count() == 60


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_reads_from_a_database(spark):
    """Extremes come from the database, parts are ranges between them, and runs are a condition of each part's query."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.createDataFrame([(f"r{i % 4}", i * 10, f"t'{i}") for i in range(100)], "RUN_ID string, N int, T string")
    rows.write.format("jdbc").options(url=url, dbtable="POSTS", createTableColumnTypes="RUN_ID varchar(20), T varchar(20)", **DERBY).save()
    got = tables.read_sql(spark, url, "POSTS", "N", parts=4, runs=["r1", "r'2"], **DERBY)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r.N for r in got.collect()) == [i * 10 for i in range(100) if i % 4 == 1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(RUN_ID" in plan
    assert tables.read_sql(spark, url, "POSTS", **DERBY).count() == 100
    assert tables.read_sql(spark, url, "POSTS", "N", runs=["none"], **DERBY).count() == 0


def test_analyses_are_written_per_run(spark, tmp_path):
    at = str(tmp_path / "a")
    rows = lambda *x: spark.createDataFrame(x, "run_id string, total long")
    tables.write_analysis(rows(("r1", 1), ("r2", 2)), at)
    tables.write_analysis(rows(("r2", 5)), at)
    assert {(r.run_id, r.total) for r in tables.read_analysis(spark, at, "total long").collect()} == {("r1", 1), ("r2", 5)}


def test_files_per_trigger(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k,)], "n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    q = tables.stream_table(spark, str(tmp_path / "in"), "n int", 1).agg(F.count(F.lit(1)).alias("c")).writeStream.outputMode("complete")
    q.foreachBatch(lambda b, i: seen.append(b.first()[0])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert seen == [1, 2, 3]
