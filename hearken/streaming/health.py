"""Account health: a state machine over signals, on a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import with_keyed_state

#: Status and hours of cooldown after a signal; others leave the status and clear the cooldown.
AFTER = {"CAPTCHA": ("BLOCKED", 24), "ACTION_BLOCKED": ("CAUTION", 1), "RATE_LIMIT": ("CAUTION", 1), "REDUCED_REACH": ("CAUTION", 1), "MANUAL_RESET": ("HEALTHY", None)}
LOG = "account string, signal_id long, signal_type string, detected_at timestamp, status_before string, status_after string, session_status string, cooldown_until timestamp"
COLUMNS = [x.split()[0] for x in LOG.split(", ")]


def health_log(signals: DataFrame, initial_session: str = "NOT_SETUP") -> DataFrame:
    """One row a signal with the status before and after, the session's status and the cooldown.

    ``signals``: ``account, signal_id, signal_type, detected_at``; in order of time, then id. An expired session stays
    expired and turns HEALTHY into CAUTION before the next signal; it leaves the cooldown alone.
    """
    w = Window.partitionBy("account").orderBy("detected_at", "signal_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    kind, expired = F.col("signal_type"), F.col("signal_type") == "SESSION_EXPIRED"
    status, cool = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    for k, (s, hours) in AFTER.items():
        status = F.when(kind == k, s).otherwise(status)
        cool = F.when(kind == k, F.col("detected_at") + F.expr(f"INTERVAL {hours} HOURS") if hours else F.lit(None).cast("timestamp")).otherwise(cool)
    s = signals.select("account", F.col("signal_id").cast("long"), "signal_type", "detected_at").withColumns(
        {
            "_set": status,
            "_cool": F.when(~expired, F.struct(cool.alias("until"))),
            "_was": F.coalesce(F.max(expired.cast("int")).over(before), F.lit(0)) == 1,
            "_is": F.max(expired.cast("int")).over(upto) == 1,
        }
    )
    base = F.coalesce(F.last("_set", ignorenulls=True).over(upto), F.lit("HEALTHY"))
    # a reset on an expired session reads HEALTHY until the next signal
    soft = F.col("_is") & (base == "HEALTHY") & F.col("_set").isNull()
    s = s.withColumn("status_after", F.when(soft, "CAUTION").otherwise(base))
    prev = F.coalesce(F.lag("status_after").over(w), F.lit("HEALTHY"))
    return s.withColumns(
        {
            "status_before": F.when(F.col("_was") & (prev == "HEALTHY"), "CAUTION").otherwise(prev),
            "session_status": F.when(F.col("_is"), "EXPIRED").otherwise(initial_session),
            "cooldown_until": F.last("_cool", ignorenulls=True).over(upto)["until"],
        }
    ).select(*COLUMNS)


def latest_state(log: DataFrame) -> DataFrame:
    """The last row of each account, with what follows from it (:func:`derived`)."""
    last = log.groupBy("account").agg(F.max_by(F.struct("status_after", "session_status", "cooldown_until", "detected_at"), F.struct("detected_at", "signal_id")).alias("s")).select("account", "s.*")
    status = F.when((F.col("session_status") == "EXPIRED") & (F.col("status_after") == "HEALTHY"), "CAUTION").otherwise(F.col("status_after"))
    return last.withColumn("health_status", status).drop("status_after")


def derived(state: DataFrame, now: Column) -> DataFrame:
    """Add ``runnable, action_required, block_reason, write_allowed, reset_allowed`` to states of accounts."""
    session, status, until = F.col("session_status"), F.col("health_status"), F.col("cooldown_until")
    blocked = status == "BLOCKED"
    action = F.when(session == "NOT_SETUP", "CONNECT_ACCOUNT").when(session == "EXPIRED", "REAUTH_REQUIRED").when(blocked, F.when(until.isNotNull(), "WAIT_COOLDOWN").otherwise("MANUAL_RESET_REQUIRED"))
    reason = F.when(session == "NOT_SETUP", "session_not_setup").when(session == "EXPIRED", "session_expired").when(blocked, "account_blocked")
    return state.withColumns(
        {
            "runnable": action.isNull(),
            "action_required": action,
            "block_reason": reason,
            "write_allowed": F.coalesce(until <= now, F.lit(False)) | (status == "HEALTHY"),
            "reset_allowed": ~(blocked & F.coalesce(until > now, F.lit(False))),
        }
    )


def step(state: tuple, kind: str, at) -> tuple[tuple, tuple]:
    """One transition: ``(status, session, cooldown)`` and a signal give the new state and ``(before, after, session, cooldown)``."""
    status, session, cooldown = state
    if session == "EXPIRED" and status == "HEALTHY":
        status = "CAUTION"
    before = status
    if kind == "SESSION_EXPIRED":
        session = "EXPIRED"
        status = "CAUTION" if status == "HEALTHY" else status
    else:
        status, hours = AFTER.get(kind, (status, None))
        cooldown = at + timedelta(hours=hours) if hours else None
    return (status, session, cooldown), (before, status, session, cooldown)


def states_after(log: DataFrame) -> DataFrame:
    """What a stream needs to go on where a batch log ended: ``account, status, session, cooldown`` (microseconds)."""
    last = F.max_by(F.struct("status_after", "session_status", F.unix_micros("cooldown_until").alias("cooldown")), F.struct("detected_at", "signal_id"))
    return log.groupBy("account").agg(last.alias("s")).select("account", F.col("s.status_after").alias("status"), F.col("s.session_status").alias("session"), "s.cooldown")


_EPOCH = datetime(1970, 1, 1)


class AccountHealth(StatefulProcessor):
    """The state machine of an account: three values, started from a stored row where there is one."""

    def __init__(self, initial_session: str):
        self.initial_session = initial_session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "status string, session string, cooldown long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.now.update((row["status"], row["session"], None if pd.isna(row["cooldown"]) else int(row["cooldown"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, session, cooldown = self.now.get() if self.now.exists() else ("HEALTHY", self.initial_session, None)
        state = (status, session, None if cooldown is None else _EPOCH + timedelta(microseconds=cooldown))
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "signal_id"], kind="stable").itertuples(index=False):
            state, (before, after, session, until) = step(state, r.signal_type, _EPOCH + timedelta(microseconds=int(r.at)))
            out.append((key[0], r.signal_id, r.signal_type, r.at, before, after, session, None if until is None else (until - _EPOCH) // timedelta(microseconds=1)))
        self.now.update((state[0], state[1], None if state[2] is None else (state[2] - _EPOCH) // timedelta(microseconds=1)))
        frame = pd.DataFrame(out, columns=["account", "signal_id", "signal_type", "at", "status_before", "status_after", "session_status", "cooldown"])
        yield frame.astype({"cooldown": "Int64"})


def stream_health_log(signals: DataFrame, initial_session: str = "NOT_SETUP", start: DataFrame | None = None) -> DataFrame:
    """:func:`health_log` on a stream: state is three values an account; signals of a trigger are taken in order.

    ``start`` has accounts' states to go on from (:func:`states_after`, or the stored table of accounts); a static table.
    """
    with_keyed_state(signals.sparkSession)
    # times as microseconds, so that no time zone comes between
    s = signals.select("account", F.col("signal_id").cast("long"), "signal_type", F.unix_micros("detected_at").alias("at"))
    out = "account string, signal_id long, signal_type string, at long, status_before string, status_after string, session_status string, cooldown long"
    first = None if start is None else start.select("account", "status", "session", F.col("cooldown").cast("long")).groupBy("account")
    log = s.groupBy("account").transformWithStateInPandas(AccountHealth(initial_session), out, "append", "none", initialState=first)
    return log.withColumns({"detected_at": F.timestamp_micros("at"), "cooldown_until": F.timestamp_micros("cooldown")}).select(*COLUMNS)
