"""Streams equal their batch twins; the stop rules equal the walk, whatever order records come in."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearken.streaming import gating, health, progress
from tests.test_gating import paths, walk


def run_stream(spark, tmp_path, parts, schema, build, mode="append"):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        assert i >= 0
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("parquet").start(str(out))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(out))


def signals(seed=3, n=200):
    rnd = random.Random(seed)
    kinds = [*health.AFTER, "SESSION_EXPIRED", "OTHER"]
    return [(f"a{rnd.randrange(6)}", i, rnd.choice(kinds), datetime(2024, 1, 1) + timedelta(minutes=i // 2)) for i in range(n)]


SIGNALS = "account string, signal_id long, signal_type string, detected_at timestamp"


def test_health_twins_and_model(spark, tmp_path):
    rows = signals()
    df = spark.createDataFrame(rows, SIGNALS)
    cols = ["account", "signal_id", "status_before", "status_after", "session_status", "cooldown_until"]
    batch = sorted(tuple(r) for r in health.health_log(df).select(*cols).collect())
    state, model = {}, []
    for a, i, kind, at in rows:
        state[a], (before, after, session, cool) = health.step(state.get(a, ("HEALTHY", "NOT_SETUP", None)), kind, at)
        model.append((a, i, before, after, session, cool))
    assert [tuple(x) for x in batch] == sorted(model)
    stream = run_stream(spark, tmp_path, [rows], SIGNALS, health.stream_health_log)
    assert sorted(tuple(r) for r in stream.select(*cols).collect()) == batch


def test_reset_on_an_expired_session(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, "SESSION_EXPIRED", t), ("a", 2, "MANUAL_RESET", t), ("a", 3, "RATE_LIMIT", t)], SIGNALS)
    assert [(r.status_before, r.status_after) for r in health.health_log(df).orderBy("signal_id").collect()] == [("HEALTHY", "CAUTION"), ("CAUTION", "HEALTHY"), ("CAUTION", "CAUTION")]


def test_derived_state(spark):
    t = datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", "BLOCKED", "VALID", t), ("b", "BLOCKED", "VALID", None), ("c", "CAUTION", "EXPIRED", None), ("d", "HEALTHY", "VALID", None), ("e", "HEALTHY", "NOT_SETUP", None)], "account string, health_status string, session_status string, cooldown_until timestamp")
    got = {r.account: (r.runnable, r.action_required, r.write_allowed, r.reset_allowed) for r in health.derived(df, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": (False, "WAIT_COOLDOWN", False, False), "b": (False, "MANUAL_RESET_REQUIRED", False, True), "c": (False, "REAUTH_REQUIRED", False, True), "d": (True, None, True, True), "e": (False, "CONNECT_ACCOUNT", True, True)}


JUDGED = "path_id string, ordinal long, decision string, relevance_score double, confidence_score double"


@pytest.mark.parametrize("seed", [5, 6])
def test_stop_stream_equals_walk(spark, tmp_path, seed):
    rows, model = paths(seed)
    rows += [(p, len(x) + 1, "END", None, None) for p, x in model.items()]
    random.Random(seed).shuffle(rows)
    out = run_stream(spark, tmp_path, [rows[i::3] for i in range(3)], JUDGED, gating.stop_stream)
    got = {}
    for r in out.orderBy("path_id", "batch_index").collect():
        got.setdefault(r.path_id, []).append((r.batch_index, r.batch_size, r.accepted_count, r.decision, r.batch_decision, r.stop_reason, r.total_accepted, r.total_scanned))
    assert got == {p: walk(x, 20) for p, x in model.items()}


def test_dedupe_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "run_id string, post_id string, source_url string, at timestamp"
    rows = [[("r", "a", "u", t), ("r", "b", "u", t)], [("r", "c", "u", t), ("r", "d", None, t), ("s", "e", "u", t), ("r", "d", "", t)]]
    out = run_stream(spark, tmp_path, rows, schema, lambda s: gating.dedupe_stream(s, "at"))
    assert sorted((r.run_id, r.source_url or "") for r in out.collect()) == [("r", ""), ("r", "u"), ("s", "u")]


def test_dedupe_forgets_after_the_delay(spark, tmp_path):
    """A copy within the delay goes; one that comes when the watermark has long passed the first is new again."""
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    schema = "run_id string, post_id string, source_url string, at timestamp"
    parts = [[("r", "a", "u", t(0))], [("r", "b", "u", t(1))], [("r", "x", "v", t(50))], [("r", "y", "w", t(51))], [("r", "c", "u", t(52))], [("r", "d", "u", t(53))]]
    out = run_stream(spark, tmp_path, parts, schema, lambda s: gating.dedupe_stream(s, "at", "2 hours"))
    assert sorted(r.post_id for r in out.collect()) == ["a", "c", "x", "y"]


def test_progress(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    df = spark.createDataFrame([("r", "1", t(0), 1, 5, None, None), ("r", "1", t(1), 2, None, 2, 1), ("r", "2", t(30), 3, None, None, None)], "run_id string, step_id string, ts timestamp, event_id long, collected long, persisted long, images long")
    s = progress.stuck_steps(progress.latest_progress(df), F.lit("2024-01-01 00:31:00").cast("timestamp"), 300).collect()
    assert [(r.step_id, r.collected_count, r.persisted_count, r.lost_before_persist_count, r.salvage_available) for r in s] == [("1", 5, 2, 3, True)]


def test_feed_ends_at_the_terminal_event(spark):
    df = spark.createDataFrame([("r", 1, "STARTED"), ("r", 2, "DONE"), ("r", 3, "late"), ("s", 1, "x")], "run_id string, n int, kind string")
    assert sorted((r.run_id, r.n) for r in progress.feed_until_end(df, "run_id", ["n"], "kind").collect()) == [("r", 1), ("r", 2), ("s", 1)]


def test_stuck_stream_equals_its_batch_twin(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "run_id string, step_id string, ts timestamp, event_id long, collected long, persisted long, images long"
    rows = [("r", "1", t(0), 1, 5, None, None), ("r", "1", t(1), 2, None, 2, 1), ("r", "2", t(30), 3, None, None, None), ("s", "1", t(2), 4, None, None, None)]
    out = run_stream(spark, tmp_path, [rows], schema, lambda s: progress.stream_stuck_steps(s, 300))
    twin = progress.stuck_steps(progress.latest_progress(spark.createDataFrame(rows, schema)), F.lit(t(30)), 300).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, twin.collect())) and out.count() == 2


def feed_parts(seed):
    """Runs with and without an end, late starters, ties of time; files that overlap in time."""
    rnd = random.Random(seed)
    t0, rows = datetime(2024, 1, 1), []
    for run in "abcd":
        for i in range(40):
            kind = "DONE" if run in "ac" and i in (25, 30) else rnd.choice(["step", "note"])
            rows.append((run, t0 + timedelta(minutes=i // 2 + 3 * "abcd".index(run)), len(rows), kind))
    order = sorted(rows, key=lambda r: r[1].timestamp() + rnd.uniform(-300, 300))
    parts = [order[k : k + 20] for k in range(0, len(order), 20)]
    return rows, [*parts, [("", t0 + timedelta(days=9), -1, "end")]]


FEED = "run_id string, ts timestamp, event_id long, kind string"


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_stream_equals_its_batch_twin(spark, tmp_path, seed):
    rows, parts = feed_parts(seed)
    out = run_stream(spark, tmp_path, parts, FEED, lambda s: progress.stream_feed(s, "11 minutes"))
    got = sorted((r.run_id, r.position, r.event_id, r.kind) for r in out.filter("run_id <> ''").collect())
    twin = progress.feed_until_end(spark.createDataFrame(rows, FEED), "run_id", ["ts", "event_id"], "kind")
    assert got == sorted((r.run_id, r.position, r.event_id, r.kind) for r in twin.collect())
    assert max(r[1] for r in got if r[0] == "a") == 26 and max(r[1] for r in got if r[0] == "b") == 40


def test_stuck_steps_keep_samples_and_activity(spark, tmp_path):
    """Samples without a count can be saved; later nulls don't overwrite, later lists do, and three are kept. Also from several triggers."""
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "run_id string, step_id string, ts timestamp, event_id long, collected long, persisted long, images long, activity string, samples array<string>"
    parts = [
        [("r", "1", t(0), 1, None, None, None, "search", ["a", "b", "c", "d"]), ("r", "2", t(0), 2, 0, None, None, None, []), ("r", "3", t(1), 3, 4, 1, 1, "open", ["x"])],
        [("r", "1", t(1), 4, None, None, None, None, None), ("r", "3", t(2), 5, None, 2, None, "scan", ["y", "z"])],
        [("r", "3", t(3), 6, None, None, None, None, []), ("end", "1", t(90), 7, None, None, None, None, None)],
    ]
    out = run_stream(spark, tmp_path, parts, schema, lambda s: progress.stream_stuck_steps(s, 300))
    got = {(r.run_id, r.step_id): (r.collected_count, r.lost_before_persist_count, r.salvage_available, r.activity, r.samples) for r in out.collect()}
    assert got == {("r", "1"): (0, 0, True, "search", ["a", "b", "c"]), ("r", "2"): (0, 0, False, None, []), ("r", "3"): (4, 2, True, "scan", [])}
    rows = [r for p in parts for r in p]
    twin = progress.stuck_steps(progress.latest_progress(spark.createDataFrame(rows, schema)), F.lit(t(90)), 300).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, twin.collect()))


def test_paths_with_holes_end(spark, tmp_path):
    """A path whose next record never comes gives up what waits, by number or by time; other paths go on."""
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = JUDGED + ", seen timestamp"
    row = lambda p, k, m: (p, k, "ACCEPTED", 0.9, 0.9, t(m))
    parts = [
        [row("many", k, 0) for k in range(2, 9)] + [row("slow", k, 0) for k in (1, 3, 4)] + [row("late", 2, 0)] + [row("good", k, 0) for k in range(1, 41)],
        [row("late", 1, 1), row("many", 1, 1)],
        [row("end", 1, 900)],
        [row("slow", 5, 901), row("late", 3, 901)],
    ]
    out = run_stream(spark, tmp_path, parts, schema, lambda s: gating.stop_stream(s, size=2, most_waiting=5, time="seen", delay="10 minutes", patience_sec=3600))
    rows = out.collect()
    gone = sorted((r.path_id, r.given_up) for r in rows if r.given_up is not None)
    assert gone == [*(("many", k) for k in range(2, 9)), ("slow", 3), ("slow", 4), ("slow", 5)]  # 5 came before the timer's turn
    done = {}
    for r in rows:
        if r.given_up is None:
            done[r.path_id] = done.get(r.path_id, 0) + r.batch_size
    assert done == {"good": 40, "late": 2}


@pytest.mark.parametrize("cut", [0, 60, 200])
def test_health_goes_on_from_stored_states(spark, tmp_path, cut):
    rows = signals()
    cols = ["account", "signal_id", "status_before", "status_after", "session_status", "cooldown_until"]
    whole = sorted(tuple(r) for r in health.health_log(spark.createDataFrame(rows, SIGNALS)).select(*cols).collect())
    first = health.health_log(spark.createDataFrame(rows[:cut], SIGNALS))
    rest = run_stream(spark, tmp_path, [rows[cut:]], SIGNALS, lambda s: health.stream_health_log(s, start=health.states_after(first)))
    assert sorted(tuple(r) for r in first.unionByName(rest).select(*cols).collect()) == whole
