"""Stateful stream operators: typed keyed state, timers and time to live.

State lives in the state store column by column: a request's head and its frames, events that came
early, a bucket's tokens, a user's live reservations. Only what changed is written. Timers and
time to live bound the store: a key that falls silent is told or forgotten. Rows of a trigger are
taken batch by batch, never gathered. The store must be RocksDB (:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from papyrine.streaming import limits, stages

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def use_rocksdb(spark: SparkSession, drain: bool = False) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB. With ``drain`` they run no batches without
    data: an available-now query with timers would never end otherwise. Timers fire in the others."""
    settings = {PROVIDER: ROCKSDB, NO_DATA_BATCHES: str(not drain).lower()}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _plain(value: Any) -> Any:
    return None if value is None or value is pd.NaT or value != value else value


def _records(batches: Iterator[pd.DataFrame], order: list[str]) -> Iterator[dict[str, Any]]:
    """The rows of each batch in order, made one at a time: a reader may stop before the last."""
    for batch in batches:
        columns = [batch[c].tolist() for c in batch.columns]
        for i in batch[order].reset_index(drop=True).sort_values(order, kind="stable").index.tolist():
            yield {name: _plain(values[i]) for name, values in zip(batch.columns, columns)}


def _frame(rows: list[dict[str, Any]], schema: str) -> pd.DataFrame:
    """Rows as plain objects, so that a null in a column of numbers stays null."""
    names = [part.split()[0] for part in schema.split(", ")]
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


class _Idle(StatefulProcessor):
    """One timer a key, moved on by every input."""

    idle_ms: int

    def _move_timer(self, now: int | None) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if now is not None:
            self.handle.registerTimer(now + self.idle_ms)

    def close(self) -> None:
        pass


class RequestStages(_Idle):
    """The stage fold of :mod:`papyrine.streaming.stages`, told once at a request's terminal event.

    Events are numbered 1, 2, ... a request. One that comes early waits in the store until those
    before it have come, so neither triggers nor batches need be in order; one that comes again is
    left out. A request silent for ``idle_ms`` takes what waits, gaps or not, and ends with TIMEOUT.
    What comes after the end changes nothing for ``keep_ms``."""

    HEAD = "stage string, whole string, candidates int, classified int, to_read array<int>, reads int, notes int, last int"
    EVENT = "type string, t long, i int, kind string, text string, document_type string, items string, error string"

    def __init__(self, idle_ms: int, keep_ms: int = DAY_MS):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD)
        self.regions = handle.getMapState("regions", "frame string", "status string")
        self.moments = handle.getMapState("moments", "name string", "ms long")
        self.early = handle.getMapState("early", "seq int", self.EVENT)
        self.ended = handle.getValueState("ended", "ended boolean", self.keep_ms)

    def _load(self) -> tuple[dict, int]:
        state = stages.start()
        if not self.head.exists():
            return state, 0
        stage, whole, candidates, classified, to_read, reads, notes, last = self.head.get()
        moments = {k[0]: v[0] for k, v in self.moments.iterator()}
        state |= {
            "stage": stage, "whole": whole, "candidates": candidates, "classified": classified, "to_read": list(to_read or []), "reads": reads, "notes": notes,
            "regions": {k[0]: v[0] for k, v in self.regions.iterator()},
            "marks": {k[5:]: v for k, v in moments.items() if k.startswith("mark:")}, "timings": {k[5:]: v for k, v in moments.items() if k.startswith("took:")},
        }
        return state, last

    def _save(self, before: dict, state: dict, last: int) -> None:
        self.head.update((state["stage"], state["whole"], state["candidates"], state["classified"], [int(i) for i in state["to_read"]], state["reads"], state["notes"], last))
        for frame in before["regions"].keys() - state["regions"].keys():
            self.regions.removeKey((frame,))
        for frame, status in state["regions"].items() - before["regions"].items():
            self.regions.updateValue((frame,), (status,))
        for kind, prefix in (("marks", "mark:"), ("timings", "took:")):
            for name, ms in state[kind].items() - before[kind].items():
                self.moments.updateValue((prefix + name,), (int(ms),))

    def _end(self, stored: bool = True) -> None:
        if stored:
            for held in (self.head, self.regions, self.moments, self.early):
                held.clear()
            self._move_timer(None)
        self.ended.update((True,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            for _ in rows:
                pass
            return
        state, last = self._load()
        # the numbers that wait, asked once: a call to the store for every event would cost more than the fold
        waiting = {k[0] for k in self.early.keys()} if self.early.exists() else set()
        stored = last > 0 or bool(waiting)
        before = {k: dict(state[k]) for k in ("regions", "marks", "timings")}
        fields = [part.split()[0] for part in self.EVENT.split(", ")]
        for event in _records(rows, ["seq"]):
            seq = int(event["seq"])
            if seq <= last:
                continue
            if seq > last + 1:
                kinds = {"t": int, "i": int}
                self.early.updateValue((seq,), tuple(kinds.get(f, str)(event[f]) if event.get(f) is not None else None for f in fields))
                waiting.add(seq)
                stored = True
                continue
            state, _ = stages.step(state, event)
            last = seq
            while not state["ended"] and last + 1 in waiting:
                last += 1
                state, _ = stages.step(state, dict(zip(fields, self.early.getValue((last,)))))
                self.early.removeKey((last,))
                waiting.remove(last)
            if state["ended"]:
                break
        for _ in rows:  # what comes after the end changes nothing
            pass
        if state["ended"]:
            self._end(stored)
            yield _frame([{"request_id": key[0], **r} for r in stages.summary(state)], stages.SUMMARY)
        else:
            self._save(before, state, last)
            self._move_timer(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, _ = self._load()
        fields = [part.split()[0] for part in self.EVENT.split(", ")]
        for _, event in sorted(((k[0], tuple(v)) for k, v in self.early.iterator()), key=lambda e: e[0]):
            state, _ = stages.step(state, dict(zip(fields, event)))
        if not state["ended"]:
            state, _ = stages.step(state, {"type": "error", "t": 0, "error": "TIMEOUT"})
        self._end()
        yield _frame([{"request_id": key[0], **r} for r in stages.summary(state)], stages.SUMMARY)


class TokenBuckets(StatefulProcessor):
    """A token bucket a key. A bucket idle for a minute has refilled, so its state lives that long.

    Requests of a batch are taken by their moment; one earlier than the bucket's last is taken at that."""

    def __init__(self, per_minute: int, keep_ms: int = limits.MINUTE_MS):
        self.per_minute, self.keep_ms = per_minute, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, at long", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = dict(zip(("tokens", "at"), self.bucket.get())) if self.bucket.exists() else limits._full()
        for batch in rows:
            out = []
            for event in _records(iter([batch]), ["at_ms", "request"]):
                state, told = limits._take(state, event | {"at_ms": max(event["at_ms"], state["at"])}, self.per_minute)
                out += [{"key": key[0], **r} for r in told]
            yield _frame(out, limits.BUCKET)
        self.bucket.update((float(state["tokens"]), int(state["at"])))

    def close(self) -> None:
        pass


class TrialReservations(StatefulProcessor):
    """Reservations of a user: admitted while successes and live ones number less than ``cap``. A
    reservation without an outcome lives for ``window_ms``; its map entry goes by its time to live."""

    OUT = "user_id long, document long, allowed boolean"

    def __init__(self, cap: int, window_ms: int):
        self.cap, self.window_ms = cap, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "n int")
        self.held = handle.getMapState("held", "document string", "at long", self.window_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        state = {"done": self.done.get()[0] if self.done.exists() else 0, "held": dict(before)}
        for batch in rows:
            out = []
            for event in _records(iter([batch]), ["at_ms", "document"]):
                state, told = limits._reserve(state, event, self.cap, self.window_ms)
                out += [{"user_id": key[0], **r} for r in told]
            yield _frame(out, self.OUT)
        self.done.update((int(state["done"]),))
        for document in before.keys() - state["held"].keys():
            self.held.removeKey((document,))
        for document, at in state["held"].items() - before.items():
            self.held.updateValue((document,), (int(at),))

    def close(self) -> None:
        pass


def _with_state(events: DataFrame, key: str, processor: Callable[[], StatefulProcessor] | StatefulProcessor, schema: str) -> DataFrame:
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def progress_stream(events: DataFrame, idle_ms: int) -> DataFrame:
    """Summaries of requests as they end, from a stream of events (request_id, seq, type, t, ...)."""
    return _with_state(events, "request_id", RequestStages(idle_ms), stages.SUMMARY)


def token_bucket_stream(requests: DataFrame, per_minute: int, keep_ms: int = limits.MINUTE_MS) -> DataFrame:
    """(key, request, allowed, retry_after_s) of a stream of requests (key, at_ms, request)."""
    return _with_state(requests, "key", TokenBuckets(per_minute, keep_ms), limits.BUCKET)


def reservation_stream(events: DataFrame, cap: int, window_ms: int) -> DataFrame:
    """(user_id, document, allowed) of a stream of reservations and outcomes (user_id, at_ms, kind, document)."""
    return _with_state(events, "user_id", TrialReservations(cap, window_ms), TrialReservations.OUT)
