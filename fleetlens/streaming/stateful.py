"""Keyed streaming forms of the operators that fold along time.

State is a few numbers per key and is dropped by event-time timers once it can
no longer matter: a block when it ends, an incident when it closes, a host or a
slot when nothing was heard of it for a given time.  A key's rows of one micro-batch are sorted in its task, so
the trigger limit of the source (``maxFilesPerTrigger`` /
``maxBytesPerTrigger``) bounds that group.  Rows are taken in event order
inside a micro-batch and in arrival order across micro-batches; rows behind the
watermark are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.greedy import accept_in_order
from fleetlens.operators.changes import INACTIVE_SECONDS, lsn, valid_in_time
from fleetlens.operators.checks import status_rank
from fleetlens.operators.intake import TTL_SECONDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state API below needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(columns, kind="stable")


class Suppressor(StatefulProcessor):
    """Accepts a row unless an earlier accepted one still blocks its key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocked = handle.getValueState("blocked", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["at_us", "tie"])
        at, until = pdf["at_us"].to_numpy(np.int64), pdf["until_us"].to_numpy(np.int64)
        blocked = int(self.blocked.get()[0]) if self.blocked.exists() else int(np.iinfo(np.int64).min)
        keep = accept_in_order(at, until, blocked)
        if keep.any():
            blocked = int(until[np.flatnonzero(keep)[-1]])
            self.blocked.update((blocked,))
            self.handle.registerTimer(blocked // 1000 + 1)
        yield pdf[["key", "tie", "at_us"]].assign(accepted=keep)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.blocked.exists() and int(self.blocked.get()[0]) <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.blocked.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _suppress(df: DataFrame, delay: str) -> DataFrame:
    """``key, tie, at, at_us, until_us`` -> the same rows with ``accepted``."""
    use_rocksdb(df.sparkSession)
    return (
        df.withWatermark("at", delay)
        .groupBy("key")
        .transformWithStateInPandas(
            Suppressor(), "key string, tie long, at_us long, accepted boolean", "append", "EventTime"
        )
    )


def suppress_within_ttl(attempts: DataFrame, delay: str = "10 minutes", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Audit attempts (``run_id, attempt_id, started_us, finished_us, handled``) the guard lets through."""
    until = F.when(F.col("handled"), F.col("finished_us") + ttl_seconds * SECOND + 1).otherwise(F.col("finished_us"))
    shaped = attempts.select(
        F.col("run_id").alias("key"), F.col("attempt_id").alias("tie"), F.timestamp_micros("started_us").alias("at"),
        F.col("started_us").alias("at_us"), F.greatest(until, F.col("started_us") + 1).alias("until_us"),
    )
    return _suppress(shaped, delay)


def reject_replays(tasks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Tasks (``nonce, task_id, issued_us, received_us, expires_us``) and whether their nonce is free; those not valid in time are left out."""
    shaped = tasks.filter(valid_in_time()).select(
        F.col("nonce").alias("key"), F.col("task_id").alias("tie"), F.timestamp_micros("received_us").alias("at"),
        F.col("received_us").alias("at_us"), F.col("expires_us").alias("until_us"),
    )
    return _suppress(shaped, delay)


class IncidentTracker(StatefulProcessor):
    """Opens an incident at the first result that is not ok and closes it at the next ok."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "opened_us long, worst int, failed long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["at_us", "tie"])
        current = tuple(int(v) for v in self.open.get()) if self.open.exists() else None
        out = []
        for at, rank in zip(pdf["at_us"].tolist(), pdf["rank"].tolist()):
            if rank > 0:
                opened, worst, failed = current or (at, 0, 0)
                current = (opened, max(worst, rank), failed + 1)
            elif current:
                out.append((key[0], current[0], at, current[1], current[2]))
                current = None
        if current:
            self.open.update(current)
            out.append((key[0], current[0], None, current[1], current[2]))
        elif self.open.exists():
            self.open.clear()
        frame = pd.DataFrame(out, columns=["monitor_id", "opened_us", "closed_us", "worst_rank", "failed_checks"])
        yield frame.astype({"closed_us": "Int64"})

    def close(self) -> None:
        pass


def open_incidents(results: DataFrame) -> DataFrame:
    """Changes of incidents, in update mode.

    Input: ``monitor_id, checked_at, event_id, status``.  A row with a null
    ``closed_us`` is an incident that is still open; the last row per
    ``(monitor_id, opened_us)`` holds.
    """
    use_rocksdb(results.sparkSession)
    shaped = results.select(
        "monitor_id", F.unix_micros("checked_at").alias("at_us"), F.col("event_id").alias("tie"), status_rank(F.col("status")).alias("rank")
    )
    return shaped.groupBy("monitor_id").transformWithStateInPandas(
        IncidentTracker(), "monitor_id long, opened_us long, closed_us long, worst_rank int, failed_checks long", "update", "None"
    )


class HostWatch(StatefulProcessor):
    """Reports a host as offline when its heartbeats stop, online when they return, and forgets it after a long silence.

    One timer a host: first for the end of its patience, then for being forgotten.
    """

    def __init__(self, factor: int, forget_seconds: int) -> None:
        self.factor, self.forget_ms = factor, forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_us long, timer_ms long, stale boolean")

    def _remember(self, last: int, timer: int, stale: bool) -> None:
        self.seen.update((last, timer, stale))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(((int(r.at_us), int(r.interval_seconds)) for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r[0])
        last, step = newest
        out = []
        if self.seen.exists():
            before, timer, stale = self.seen.get()
            if int(before) >= last:
                return
            self.handle.deleteTimer(int(timer))
            if stale:
                out.append((key[0], "online", last))
        self._remember(last, last // 1000 + self.factor * (step if step > 0 else 30) * 1000, False)
        yield pd.DataFrame(out, columns=["host_id", "state", "last_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.seen.exists():
            last, timer, stale = self.seen.get()
            if int(timer) <= expiredTimerInfo.getExpiryTimeInMs():
                if not stale:
                    out.append((key[0], "offline", int(last)))
                forget = max(int(timer) + 1, int(last) // 1000 + self.forget_ms)
                if stale or forget <= timerValues.getCurrentWatermarkInMs():
                    self.seen.clear()
                else:
                    self._remember(int(last), forget, True)
        yield pd.DataFrame(out, columns=["host_id", "state", "last_us"])

    def close(self) -> None:
        pass


def stale_hosts(heartbeats: DataFrame, factor: int = 3, delay: str = "1 minute", forget_seconds: int = 30 * 86_400) -> DataFrame:
    """``offline`` / ``online`` changes of hosts (``host_id, seen_at, interval_seconds``).

    A host that was offline and silent for ``forget_seconds`` is forgotten; if
    it comes back, it is a new host, for which nothing is reported.
    """
    use_rocksdb(heartbeats.sparkSession)
    shaped = heartbeats.select("host_id", "seen_at", F.unix_micros("seen_at").alias("at_us"), "interval_seconds")
    return (
        shaped.withWatermark("seen_at", delay)
        .groupBy("host_id")
        .transformWithStateInPandas(HostWatch(factor, forget_seconds), "host_id long, state string, last_us long", "append", "EventTime")
    )


class SlotWatch(StatefulProcessor):
    """First decision about a replication slot; a slot of which no poll comes any more is forgotten."""

    def __init__(self, forget_seconds: int) -> None:
        self.forget_ms = forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", "inactive_since long, decided boolean, timer_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        since, decided, timer = self.state.get() if self.state.exists() else (-1, False, -1)
        since, timer, out, last = int(since), int(timer), [], 0
        for row in _in_order(rows, ["at_us", "poll_id"]).itertuples(index=False):
            last = row.at_us
            if decided:
                continue
            since = -1 if row.active else (row.at_us if since < 0 else since)
            if row.gone:
                reason = "slot vanished"
            elif since >= 0 and row.at_us - since > INACTIVE_SECONDS * SECOND:
                reason = "slot inactive"
            elif row.over:
                reason = "log over its ceiling"
            elif row.done:
                reason = "caught up"
            elif row.late:
                reason = "deadline"
            else:
                continue
            decided = True
            out.append((key[0], reason, row.at_us))
        forget = max(timer, last // 1000 + self.forget_ms)
        if forget != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(forget)
        self.state.update((since, bool(decided), forget))
        yield pd.DataFrame(out, columns=["slot_id", "status", "decided_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists() and int(self.state.get()[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=["slot_id", "status", "decided_us"])

    def close(self) -> None:
        pass


def catchup_status(samples: DataFrame, delay: str = "10 minutes", forget_seconds: int = 7 * 86_400) -> DataFrame:
    """Decisions about replication slots; input as in the batch form.

    ``forget_seconds`` after its last poll a slot's state is dropped, decided
    or not; polls of that name which come later are those of a new slot.
    """
    use_rocksdb(samples.sparkSession)
    zero = F.lit(0).cast("decimal(38,0)")
    applied = F.greatest(F.coalesce(lsn(F.col("remote_lsn")), zero), F.coalesce(lsn(F.col("latest_end_lsn")), zero)) >= lsn(F.col("source_lsn"))
    shaped = samples.select(
        "slot_id", "poll_id", "at", F.unix_micros("at").alias("at_us"), "active", (F.col("wal_bytes") > F.col("max_wal_bytes")).alias("over"),
        (F.col("ready") & F.coalesce(applied, F.lit(False))).alias("done"), (F.col("at") > F.col("deadline")).alias("late"),
        (~F.coalesce("present", F.lit(True))).alias("gone"),
    )
    return shaped.withWatermark("at", delay).groupBy("slot_id").transformWithStateInPandas(
        SlotWatch(forget_seconds), "slot_id long, status string, decided_us long", "append", "EventTime")
