"""Request budgets: a token bucket a key, and trial documents a user."""

from __future__ import annotations

import math
from functools import partial
from typing import Any

from pyspark.sql import DataFrame

from papyrine.streaming.fold import State, batch_fold, stream_fold

MINUTE_MS = 60_000


def _full() -> State:
    return {"tokens": None, "at": 0}


def _take(state: State, event: dict[str, Any], per_minute: int) -> tuple[State, list[dict[str, Any]]]:
    at, rate = event["at_ms"], per_minute / MINUTE_MS
    tokens = per_minute if state["tokens"] is None else min(per_minute, state["tokens"] + (at - state["at"]) * rate)
    allowed = tokens >= 1
    wait = None if allowed else max(1, math.ceil((1 - tokens) / rate / 1000))
    return {"tokens": tokens - allowed, "at": at}, [{"request": event["request"], "allowed": allowed, "retry_after_s": wait}]


BUCKET = "key string, request long, allowed boolean, retry_after_s int"


def token_bucket(requests: DataFrame, per_minute: int) -> DataFrame:
    """(key, request, allowed, retry_after_s) of requests (key, at_ms, request): a bucket holds a
    minute's requests and refills evenly."""
    return batch_fold(requests, "key", ["at_ms", "request"], _full, partial(_take, per_minute=per_minute), BUCKET)


def token_bucket_stream(requests: DataFrame, per_minute: int) -> DataFrame:
    """The same over a stream; a key idle for a minute has refilled and is forgotten."""
    return stream_fold(requests, "key", ["at_ms", "request"], _full, partial(_take, per_minute=per_minute), BUCKET, MINUTE_MS)


def _reserve(state: State, event: dict[str, Any], cap: int, window_ms: int) -> tuple[State, list[dict[str, Any]]]:
    at, held = event["at_ms"], {k: v for k, v in state["held"].items() if v > event["at_ms"] - window_ms}
    document, done = str(event["document"]), state["done"]
    if event["kind"] == "reserve":
        allowed = done + len(held) < cap
        return {"done": done, "held": held | ({document: at} if allowed else {})}, [{"document": event["document"], "allowed": allowed}]
    held.pop(document, None)
    return {"done": done + (event["kind"] == "success"), "held": held}, []


def trial_reservations(events: DataFrame, cap: int, window_ms: int) -> DataFrame:
    """(user_id, document, allowed) of reservations among the events (user_id, at_ms, kind:
    reserve, success or failure, document): admitted while successes and live reservations
    number less than ``cap``."""
    start = lambda: {"done": 0, "held": {}}
    return batch_fold(events, "user_id", ["at_ms", "document"], start, partial(_reserve, cap=cap, window_ms=window_ms), "user_id long, document long, allowed boolean")
