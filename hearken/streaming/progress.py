"""Progress of steps: last heartbeat, steps that got stuck with what can be saved, and a run's events up to its end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.terms import TERMINAL_EVENTS
from .state import with_keyed_state

#: Samples of a stuck step that are kept; fields that events need not have.
SAMPLES = 3
OPTIONAL = {"activity": "string", "samples": "array<string>"}


def _given(events: DataFrame, c: str, kind: str) -> Column:
    return F.col(c) if c in events.columns else F.lit(None).cast(kind).alias(c)


def latest_progress(events: DataFrame) -> DataFrame:
    """Merged progress of each step: the last value of each field, and the last heartbeat.

    ``events``: ``run_id, step_id, ts, event_id, collected, persisted, images``, and ``activity, samples`` if there are any; null
    fields don't overwrite.
    """
    at = F.struct("ts", "event_id")
    events = events.select("*", *[_given(events, c, k) for c, k in OPTIONAL.items() if c not in events.columns])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return events.groupBy("run_id", "step_id").agg(F.max("ts").alias("heartbeat_at"), last("collected"), last("persisted"), last("images"), *[last(c) for c in OPTIONAL])


def stuck_rows(progress: DataFrame) -> DataFrame:
    """What a stuck step leaves: its failure class, what was collected and not persisted, whether it can be saved (something was
    collected, or there are samples), what it did last and up to ``SAMPLES`` samples."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    samples = F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, SAMPLES)
    return progress.select(
        "run_id", "step_id", "heartbeat_at", F.lit("STEP_STUCK_TIMEOUT").alias("failure_class"), n("collected").alias("collected_count"), n("persisted").alias("persisted_count"),
        F.greatest(n("collected") - n("persisted"), F.lit(0)).alias("lost_before_persist_count"), n("images").alias("image_candidate_count"), ((n("collected") > 0) | (F.size(samples) > 0)).alias("salvage_available"),
        "activity", samples.alias("samples"),
    )


def stuck_steps(progress: DataFrame, now: Column, limit_sec: float) -> DataFrame:
    """Steps whose last heartbeat is more than ``limit_sec`` old at ``now``, with what was collected but not persisted."""
    late = (F.unix_micros(now) - F.unix_micros("heartbeat_at")) / 1e6 > limit_sec
    return stuck_rows(progress.filter(late))


class StuckSteps(StatefulProcessor):
    """Progress of a step as values, its samples as a list, and a timer that the next heartbeat puts off."""

    FIELDS = ("collected", "persisted", "images", "activity")

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.merged = handle.getValueState("merged", "at long, event_id long, collected long, persisted long, images long, activity string, timer long")
        self.samples = handle.getListState("samples", "sample string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, event, *values, timer = self.merged.get() if self.merged.exists() else (None,) * 7
        new = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        if at is not None:  # what came before has its fields already
            new = new[[(a, e) >= (at, event) for a, e in zip(new["at"], new["event_id"], strict=True)]]
        for r in new.itertuples(index=False):
            at, event = int(r.at), int(r.event_id)
            for k, c in enumerate(self.FIELDS):
                v = getattr(r, c)
                if v is not None and not pd.isna(v):
                    values[k] = v if c == "activity" else int(v)
            if r.samples is not None:
                self.samples.clear()
                if len(r.samples):
                    self.samples.put([(x,) for x in list(r.samples)[:SAMPLES]])
        if len(new):
            due = max(at // 1000 + self.limit_ms, timerValues.getCurrentWatermarkInMs() + 1)
            if timer != due:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.merged.update((at, event, *values, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, *values, _ = self.merged.get()
        samples = [x[0] for x in self.samples.get()] if self.samples.exists() else None
        self.merged.clear()
        self.samples.clear()
        frame = pd.DataFrame([(*key, at, *values, samples)], columns=["run_id", "step_id", "at", *self.FIELDS, "samples"])
        yield frame.astype({c: "Int64" for c in ("collected", "persisted", "images")})


def stream_stuck_steps(events: DataFrame, limit_sec: int, delay: str = "0 seconds") -> DataFrame:
    """:func:`stuck_steps` on a stream: a step is reported when the watermark passes its last heartbeat by ``limit_sec``."""
    with_keyed_state(events.sparkSession)
    # times as microseconds, so that no time zone comes between
    e = events.withWatermark("ts", delay)
    e = e.select("run_id", "step_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "collected", "persisted", "images", *[_given(e, c, k) for c, k in OPTIONAL.items()])
    out = "run_id string, step_id string, at long, collected long, persisted long, images long, activity string, samples array<string>"
    late = e.groupBy("run_id", "step_id").transformWithStateInPandas(StuckSteps(limit_sec * 1000), out, "append", "eventTime")
    return stuck_rows(late.withColumn("heartbeat_at", F.timestamp_micros("at")))


class OrderedFeed(StatefulProcessor):
    """Events of a run wait by their time until the watermark has passed them, come out in order with their places, and end with the
    first terminal one; what comes after it is ignored."""

    def __init__(self, terminal: Sequence[str]):
        self.terminal = frozenset(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "kind string")
        self.told = handle.getValueState("told", "position long, ended boolean, timer long")

    def _wait(self, told: tuple, first: int | None) -> None:
        """Keep what was told, with one timer for the first event that waits."""
        position, ended, timer = told
        due = None if first is None else -(-first // 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.told.update((position, ended, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = self.told.get() if self.told.exists() else (0, False, None)
        first = None
        for b in rows:
            for r in b.itertuples(index=False) if not told[1] else ():
                self.waiting.updateValue((int(r.at), int(r.event_id)), (r.kind,))
                first = int(r.at) if first is None else min(first, int(r.at))
        if first is not None:
            timer = told[2]
            self._wait(told, first if timer is None else min(first, timer * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        position, ended, _ = self.told.get()
        kinds = {tuple(k): v[0] for k, v in self.waiting.iterator()}
        out, left = [], None
        for at, event in sorted(kinds):
            if at > upto:
                left = at
                break
            position += 1
            out.append((*key, position, at, event, kinds[at, event]))
            self.waiting.removeKey((at, event))
            if kinds[at, event] in self.terminal:
                ended = True
                self.waiting.clear()
                break
        self._wait((position, ended, None), left)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "position", "at", "event_id", "kind"])


def stream_feed(events: DataFrame, delay: str, terminal: Sequence[str] = TERMINAL_EVENTS) -> DataFrame:
    """:func:`feed_until_end` on a stream: ``run_id, position, at, event_id, kind`` (``at`` in microseconds), appended in order within a run.

    ``events``: ``run_id, ts, event_id, kind``; they may come up to ``delay`` out of order.
    """
    with_keyed_state(events.sparkSession)
    e = events.withWatermark("ts", delay).select(F.col("run_id").cast("string").alias("run_id"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "kind")
    return e.groupBy("run_id").transformWithStateInPandas(OrderedFeed(terminal), "run_id string, position long, at long, event_id long, kind string", "append", "eventTime")


def feed_until_end(events: DataFrame, run: str, order: Sequence[str], kind: str, terminal: Sequence[str] = TERMINAL_EVENTS) -> DataFrame:
    """Events of each run, numbered in order, up to its first terminal one."""
    w = Window.partitionBy(run).orderBy(*order)
    ended = F.coalesce(F.max(F.col(kind).isin(*terminal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = events.withColumns({"_ended": ended, "position": F.row_number().over(w)})
    return e.filter("_ended = 0").drop("_ended")
