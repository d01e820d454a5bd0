"""Attempt lifecycle on a stream: batches folded into a table of states; keyed state where timers are needed.

``store_events`` maps a batch to one transition map an attempt and applies it to the stored state, with DataFrame
jobs only, so an attempt may have any number of events in a batch.  The processors keep the state in
RocksDB and recover silent attempts by timer, in processing time or in the events' own time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.attempts import ACTIONS, advanced, lifecycle_maps, lifecycle_states, next_state
from ..sources import filed

CODES = {a: i for i, a in enumerate(ACTIONS)}
OUTPUT = "id string, events long, status string, retry_count int"


STATE = "id string, events long, status string, retry_count int"


def store_events(batch: DataFrame, batch_id: int, path: str, max_retries: int = 3, buckets: int | None = None) -> None:
    """Bring the table of states up to a batch of (id, ordinal, action); a repeated batch changes nothing."""
    spark = batch.sparkSession
    events = batch.persist()
    maps = lifecycle_maps(events, "id", "ordinal", "action", max_retries).persist()
    try:
        if not filed.exists(spark, path):
            filed.create(spark.createDataFrame([], STATE), path, "id", buckets)
        filed.change(spark, path, filed.buckets_of(spark, path, maps, "id"), lambda old: advanced(old, maps, "id", max_retries), batch_id)
    finally:
        maps.unpersist()
        events.unpersist()


def lifecycle_table(events: DataFrame, path: str, checkpoint: str, max_retries: int = 3, buckets: int | None = None) -> DataStreamWriter:
    """Writer for a stream of (id, ordinal, action); the states are ``filed.read(spark, path)``.  Events of one
    batch are applied by ordinal, batches in their order."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store_events(batch, batch_id, path, max_retries, buckets)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


class Lifecycle(StatefulProcessor):
    """State per attempt: (status, retry_count, number of events).

    Of the events of one attempt inside a micro-batch only ordinals and action codes are held (nine
    bytes an event), put in order and folded as arrays; the source's rate limit
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds them.
    An attempt still running ``stale_minutes`` after its last event is recovered by a
    processing-time timer.
    """

    def __init__(self, max_retries: int = 3, stale_minutes: float | None = None):
        self.max_retries = max_retries
        self.stale_ms = None if stale_minutes is None else int(stale_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", "status string, retry_count int, events long")

    def _load(self):
        stored = self.state.get() if self.state.exists() else None
        return tuple(stored) if stored else ("pending", 0, 0)

    def after(self, state: tuple[str, int], codes: np.ndarray) -> tuple[str, int]:
        """State after the ordered actions.  An action maps every state to the next one and maps
        compose, so neighbours are joined pairwise until one map is left."""
        states = lifecycle_states(self.max_retries)
        steps = np.array([[states.index(next_state(s, a, self.max_retries)) for s in states] for a in ACTIONS])
        maps = steps[codes]
        while len(maps) > 1:
            pairs = np.take_along_axis(maps[1::2], maps[: len(maps) // 2 * 2: 2], axis=1)
            maps = np.concatenate([pairs, maps[len(maps) // 2 * 2:]])
        return states[maps[0][states.index(state)]] if len(maps) else state

    def _row(self, key, status, retries, events) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "events": [events], "status": [status], "retry_count": [retries]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, retries, events = self._load()
        ordinals, codes = [], []
        for part in rows:
            events += len(part)
            code = part["action"].map(CODES)
            ordinals.append(part["ordinal"].to_numpy()[code.notna()])
            codes.append(code.dropna().to_numpy(np.int8))
        order = np.argsort(np.concatenate(ordinals), kind="stable")
        status, retries = self.after((status, int(retries)), np.concatenate(codes)[order])
        self.state.update((status, int(retries), int(events)))
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status == "running":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        yield self._row(key, status, int(retries), int(events))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, retries, events = self._load()
        if status == "running":
            status = "pending" if retries < self.max_retries else "failed"
            self.state.update((status, int(retries), int(events)))
            yield self._row(key, status, int(retries), int(events))

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, max_retries: int = 3, stale_minutes: float | None = None) -> DataFrame:
    """Stream of (id, ordinal, action) to the changing state of every attempt.  The session needs
    RocksDB as its state store (``session.tune``)."""
    return events.groupBy("id").transformWithStateInPandas(
        statefulProcessor=Lifecycle(max_retries, stale_minutes), outputStructType=OUTPUT,
        outputMode="Update", timeMode="None" if stale_minutes is None else "ProcessingTime")


class Recovery(StatefulProcessor):
    """State per attempt: (status, retry_count, number of events, time of the last event in milliseconds).

    Recovery goes by the events' own times, so a repeated run gives the same result: an attempt that is
    still running more than ``stale_minutes`` after its last event is recovered before its next event is applied, or
    by a timer once the watermark has passed that time.  Events of a batch are applied in order of
    (time, ordinal); one that arrives in a later batch than a younger one is applied on arrival.
    """

    def __init__(self, stale_minutes: float, max_retries: int = 3):
        self.stale_ms, self.max_retries = int(stale_minutes * 60_000), max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", "status string, retry_count int, events long, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.state.get() if self.state.exists() else None
        status, retries, events, last = stored or ("pending", 0, 0, None)
        before, recovered = last, False
        for at, _, action in sorted((r["at_ms"], r["ordinal"], r["action"]) for r in rows):
            if status == "running" and last is not None and at - last > self.stale_ms:
                status, retries = next_state((status, retries), "fail", self.max_retries)
                recovered = True
            status, retries = next_state((status, retries), action, self.max_retries)
            last, events = at if last is None else max(last, at), events + 1
        self.state.update((status, retries, events, last))
        if before is not None:
            self.handle.deleteTimer(before + self.stale_ms)
        if status == "running":
            self.handle.registerTimer(last + self.stale_ms)
        yield Row(id=key[0], events=events, status=status, retry_count=retries, recovered=recovered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, retries, events, last = self.state.get()
        if status == "running":
            status, retries = next_state((status, retries), "fail", self.max_retries)
            self.state.update((status, retries, events, last))
            yield Row(id=key[0], events=events, status=status, retry_count=retries, recovered=True)

    def close(self) -> None:
        pass


def recovery_stream(events: DataFrame, stale_minutes: float, max_retries: int = 3, late: str = "0 seconds") -> DataFrame:
    """Stream of (id, ordinal, action, ts) to (id, events, status, retry_count, recovered) whenever an attempt
    changes; ``late`` is how far events may lag behind the newest one."""
    timed = events.withWatermark("ts", late).selectExpr("id", "ordinal", "action", "ts", "unix_millis(ts) AS at_ms")
    return timed.groupBy("id").transformWithState(
        statefulProcessor=Recovery(stale_minutes, max_retries),
        outputStructType="id string, events long, status string, retry_count int, recovered boolean",
        outputMode="Update", timeMode="EventTime")
