"""Gating on streams: duplicates, scores against static profiles, and stop rules per path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import dedupe_key
from ..operators.scoring import gate_records
from .state import with_keyed_state


def dedupe_stream(candidates: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Candidates as they arrive, the first of each address (or id) within a run; state is kept for ``delay``."""
    keyed = candidates.withColumn("key", dedupe_key()).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["run_id", "key"]).drop("key")


def gate_stream(candidates: DataFrame, contexts: DataFrame, **markers) -> DataFrame:
    """Candidates with their judgement; ``contexts`` (``run_id, profile, spec``) is a static table of few rows a run."""
    return gate_records(candidates.join(contexts, "run_id"), **markers)


SUMMARY = "path_id string, batch_index int, batch_size long, accepted_count long, uncertain_count long, high_conf_accept_count long, decision string, batch_decision string, stop_reason string, total_accepted long, total_scanned long"
_COLUMNS = [x.split()[0] for x in SUMMARY.split(", ")]


class StopRules(StatefulProcessor):
    """Counters of a path as one value; records that came too early as a map by ordinal, which ends by number or by event time."""

    COUNTERS = "next long, batch int, n long, accepted long, uncertain long, high long, total_accepted long, total_scanned long, weak long, zero long, closed boolean, waiting long, timer long, seen long"

    def __init__(self, size, high_conf, min_accept, min_high, floor, max_weak, max_zero, max_scanned, min_accepted, most_waiting, patience_ms, timed):
        self.size, self.high_conf, self.min_accept, self.min_high, self.floor = size, high_conf, min_accept, min_high, floor
        self.max_weak, self.max_zero, self.max_scanned, self.min_accepted = max_weak, max_zero, max_scanned, min_accepted
        self.most_waiting, self.patience_ms, self.timed = most_waiting, patience_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", self.COUNTERS)
        self.waiting = handle.getMapState("waiting", "ordinal long", "decision string, relevance double, confidence double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = dict(zip(self._names(), self.counters.get() if self.counters.exists() else (1, 1, 0, 0, 0, 0, 0, 0, 0, 0, False, 0, None, 0), strict=True))
        new: dict[int, tuple] = {}
        for b in rows:
            for r in b.itertuples(index=False):
                new[int(r.ordinal)] = (r.decision, float(r.relevance_score or 0), float(r.confidence_score or 0))
                c["seen"] = max(c["seen"], int(r.ms))
        out, given_up, before = [], [], c["next"]
        while not c["closed"]:
            at = c["next"]
            if at in new:
                record = new.pop(at)
            elif c["waiting"] and self.waiting.containsKey((at,)):
                record = tuple(self.waiting.getValue((at,)))
                self.waiting.removeKey((at,))
                c["waiting"] -= 1
            else:
                break
            c["next"] += 1
            out += self._take(key[0], c, *record)
        if c["closed"]:
            if c["waiting"]:
                self.waiting.clear()
                c["waiting"] = 0
        else:
            for ordinal, record in new.items():
                if ordinal > c["next"] and not self.waiting.containsKey((ordinal,)):
                    c["waiting"] += 1
                    self.waiting.updateValue((ordinal,), record)
            if c["waiting"] > self.most_waiting:
                given_up = self._give_up(c)
        self._keep(c, timerValues, c["next"] != before)
        if out or given_up:
            yield self._frame(key[0], out, given_up)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = dict(zip(self._names(), self.counters.get(), strict=True))
        c["timer"] = None
        given_up = self._give_up(c) if c["waiting"] and not c["closed"] else []
        self._keep(c, timerValues)
        if given_up:
            yield self._frame(key[0], [], given_up)

    def _names(self) -> list[str]:
        return [x.split()[0] for x in self.COUNTERS.split(", ")]

    def _take(self, path: str, c: dict, decision: str, relevance: float, confidence: float) -> list[tuple]:
        """Count a record; the summary of its batch, if that is full or at an end."""
        if decision != "END":
            c["n"] += 1
            c["accepted"] += decision == "ACCEPTED"
            c["uncertain"] += decision == "UNCERTAIN"
            c["high"] += decision == "ACCEPTED" and confidence >= self.high_conf and relevance >= confidence * 0.6
        n, accepted = c["n"], c["accepted"]
        if n == 0 or (decision != "END" and n < self.size):
            return []
        health = "continue" if accepted / n >= self.min_accept or c["high"] / n >= self.min_high else "reformulate" if c["uncertain"] / n >= self.floor else "weak"
        c["total_accepted"] += accepted
        c["total_scanned"] += n
        c["weak"] = c["weak"] + 1 if health == "weak" else 0
        c["zero"] = 0 if accepted else c["zero"] + 1
        none_yet = c["total_accepted"] == 0
        rules = {
            "weak_batches_exceeded": c["weak"] >= self.max_weak,
            "zero_accepted_batches_exceeded": none_yet and c["zero"] >= self.max_zero,
            "min_accepts_not_reached": c["total_scanned"] >= self.max_scanned and c["total_accepted"] < self.min_accepted,
        }
        reason = next((name for name, hit in reversed(rules.items()) if hit), None)
        verdict = "stop" if reason else "reformulate" if health == "reformulate" and none_yet else "continue"
        row = (path, c["batch"], n, accepted, c["uncertain"], c["high"], health, verdict, reason, c["total_accepted"], c["total_scanned"])
        c |= {"batch": c["batch"] + 1, "n": 0, "accepted": 0, "uncertain": 0, "high": 0, "closed": verdict != "continue"}
        return [row]

    def _give_up(self, c: dict) -> list[int]:
        """The path ends at its hole; what waits behind it comes out."""
        gone = sorted(k[0] for k in self.waiting.keys())
        self.waiting.clear()
        c |= {"waiting": 0, "closed": True}
        return gone

    def _keep(self, c: dict, timerValues, moved: bool = False) -> None:
        if moved and c["timer"] is not None:  # what waits now waits for another hole
            self.handle.deleteTimer(c["timer"])
            c["timer"] = None
        if c["waiting"] and c["timer"] is None and self.timed:
            # from where the watermark stands when the first record begins to wait
            c["timer"] = max(timerValues.getCurrentWatermarkInMs(), c["seen"]) + self.patience_ms
            self.handle.registerTimer(c["timer"])
        elif not c["waiting"] and c["timer"] is not None:
            self.handle.deleteTimer(c["timer"])
            c["timer"] = None
        self.counters.update(tuple(int(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in c.values()))

    def _frame(self, path: str, out: list[tuple], given_up: list[int]) -> pd.DataFrame:
        rows = [(*r, None) for r in out] + [(path, *[None] * (len(_COLUMNS) - 1), k) for k in given_up]
        counts = [x.split()[0] for x in SUMMARY.split(", ") if x.endswith((" long", " int"))]
        return pd.DataFrame(rows, columns=[*_COLUMNS, "given_up"]).astype({c: "Int64" for c in (*counts, "given_up")})


def stop_stream(judged: DataFrame, size=20, high_conf=0.75, min_accept=0.15, min_high=0.05, floor=0.25, max_weak=2, max_zero=2, max_scanned=60, min_accepted=3, most_waiting=10_000, time: str | None = None, delay="1 hour", patience_sec=3600) -> DataFrame:
    """A summary of each batch of a path as soon as it is full, until the path stops; later records are ignored.

    ``judged``: ``path_id, ordinal`` (from 1), ``decision, relevance_score, confidence_score``; a record with decision ``END`` closes
    the last batch. Records that come early wait for those before them. If more than ``most_waiting`` wait in a path or, with a column ``time``,
    the watermark (``delay`` behind) has moved ``patience_sec`` beyond the newest record that was there when the first began to wait, the path ends at its hole: each record
    behind it comes out as a row of its own with its ordinal in ``given_up``, which is null in summaries. What comes later to such a path is
    ignored like what comes after a stop, so state is bounded. Same rules as :func:`hearken.operators.batches.apply_stop_rules`.
    """
    with_keyed_state(judged.sparkSession)
    rules = StopRules(size, high_conf, min_accept, min_high, floor, max_weak, max_zero, max_scanned, min_accepted, most_waiting, patience_sec * 1000, time is not None)
    columns = [F.col("path_id").cast("string").alias("path_id"), F.col("ordinal").cast("long").alias("ordinal"), "decision", "relevance_score", "confidence_score"]
    if time is None:
        j, mode = judged.select(*columns, F.lit(0).cast("long").alias("ms")), "none"
    else:
        j, mode = judged.withWatermark(time, delay).select(*columns, F.unix_millis(time).alias("ms"), time), "eventTime"
    return j.groupBy("path_id").transformWithStateInPandas(rules, f"{SUMMARY}, given_up long", "append", mode)


def run_counters(posts: DataFrame) -> DataFrame:
    """Totals by run and status, for update mode."""
    return posts.groupBy("run_id", F.coalesce("pre_ai_status", F.lit("NULL")).alias("pre_ai_status")).agg(F.count(F.lit(1)).alias("count"))
