"""Ordered folds over the events of each key, in batch and as a stream.

A fold has ``start()`` (a JSON-able state), ``step(state, event)`` -> (state, output rows). The
batch form shuffles by key, sorts within partitions and keeps one key's state at a time, so a
key's events are never gathered. The stream keeps each key's state as JSON; events of one
trigger are applied in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = dict[str, Any]
Step = Callable[[State, dict[str, Any]], tuple[State, list[dict[str, Any]]]]
BATCH_ROWS = 10_000


def _plain(value: Any) -> Any:
    return None if value is None or value is pd.NaT or value != value else value


def batch_fold(events: DataFrame, key: str, order: list[str], start: Callable[[], State], step: Step, schema: str, finish: Callable[[State], list[dict[str, Any]]] | None = None) -> DataFrame:
    """Output rows of every step, and of ``finish`` at the end of each key."""
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, rows = None, None, []
        for batch in batches:
            for event in batch.to_dict("records"):
                if state is None or event[key] != current:
                    if state is not None and finish:
                        rows += [{key: current, **r} for r in finish(state)]
                    current, state = event[key], start()
                state, out = step(state, {k: _plain(v) for k, v in event.items()})
                rows += [{key: current, **r} for r in out]
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if state is not None and finish:
            rows += [{key: current, **r} for r in finish(state)]
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def stream_fold(
    events: DataFrame, key: str, order: list[str], start: Callable[[], State], step: Step, schema: str, idle_ms: int | None = None, on_idle: Callable[[State], list[dict[str, Any]]] | None = None
) -> DataFrame:
    """The same fold over a stream; a key silent for ``idle_ms`` gives ``on_idle`` and is forgotten."""
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            rows = [{key: keys[0], **r} for r in (on_idle(json.loads(held.get[0])) if on_idle else [])]
            held.remove()
        else:
            state, rows = json.loads(held.get[0]) if held.exists else start(), []
            for event in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
                state, out = step(state, {k: _plain(v) for k, v in event.items()})
                rows += [{key: keys[0], **r} for r in out]
            held.update((json.dumps(state, default=str),))
            if idle_ms:
                held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)
