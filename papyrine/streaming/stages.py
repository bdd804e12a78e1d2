"""Progress of a reading request, folded from its stage events.

Events: ``type`` and ``t`` (ms), and by type ``i`` (a frame, null for the whole page), ``kind``,
``text``, ``document_type``, ``items`` (JSON: frames of ``regions`` and ``triage``), ``error``. One
terminal event counts; what follows it, and unknown types, change nothing.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame

from papyrine.streaming.fold import State, batch_fold, stream_fold

SUMMARY = (
    "request_id string, stage string, candidates int, classified int, to_read int, read_count int, detect_ms long, classify_ms long, read_ms long, merge_ms long, "
    "n_notes int, regions string, error string, error_stage string"
)
_UNREAD = re.compile(r"^Region (\d+) .*could not be read")


def start() -> State:
    return {"stage": "uploading", "regions": {}, "whole": None, "candidates": 0, "classified": 0, "to_read": [], "reads": 0, "timings": {}, "marks": {}, "notes": 0, "error": None, "ended": False}


def _since(state: State, mark: str, t: int, default: int | None = None) -> int:
    return t - state["marks"].get(mark, t if default is None else default)


def _counted_read(state: State) -> None:
    state["reads"] += 1
    if state["reads"] >= len(state["to_read"]):
        state["stage"] = "merging"


def step(state: State, event: dict[str, Any]) -> tuple[State, list]:
    """The state after one event."""
    if state["ended"]:
        return state, []
    kind, t = event["type"], event["t"]
    frame = None if event.get("i") is None else str(int(event["i"]))
    regions, timings, marks = state["regions"], state["timings"], state["marks"]
    items = json.loads(event["items"]) if event.get("items") else {}
    if kind == "page":
        state["stage"], marks["page"] = "detecting", t
    elif kind == "regions":
        state["regions"] = {str(r["i"]): "skipped" if r.get("skipped") else "found" for r in items}
        state["candidates"] = sum(s != "skipped" for s in state["regions"].values()) if items else 1
        state["stage"], marks["regions"], timings["detect"] = "classifying", t, _since(state, "page", t, 0)
    elif kind == "classified":
        state["classified"] += 1
        timings["classify"] = _since(state, "regions", t)
        if regions.get(frame) == "found":
            regions[frame] = "classified"
    elif kind == "triage":
        state["to_read"] = items["read"]
        state["candidates"] = state["classified"] or len(items["read"]) + len(items["skipped"])
        state["stage"], marks["triage"] = "reading", t
        regions.update({str(i): "skipped" for i in items["skipped"] if str(i) in regions})
    elif kind == "reading":
        state["stage"] = "reading"
        if frame is None:
            state["whole"] = "reading"
        elif frame in regions:
            regions[frame] = "reading"
    elif kind == "read":
        status = "failed" if event.get("document_type") == "unreadable" else "read"
        state["stage"], timings["read"], marks["last"] = "reading", _since(state, "triage", t), t
        _counted_read(state)
        if frame is None:
            state["whole"] = status
        elif frame in regions:
            regions[frame] = status
    elif kind == "note":
        state["notes"] += 1
        if unread := _UNREAD.match(event.get("text") or ""):
            at = str(int(unread[1]) - 1)
            if regions.get(at) == "failed":
                if state["reads"] >= len(state["to_read"]):
                    state["stage"] = "merging"
            else:
                _counted_read(state)
            if at in regions:
                regions[at] = "failed"
    elif kind == "done":
        timings["merge"] = _since(state, "last", t)
        state["stage"], state["ended"] = "done", True
    elif kind == "error":
        state["error"] = [event.get("error"), state["stage"]]
        state["regions"] = {i: "failed" if s == "reading" else s for i, s in regions.items()}
        state["whole"] = "failed" if state["whole"] == "reading" else state["whole"]
        state["stage"], state["ended"] = "error", True
    return state, []


def summary(state: State) -> list[dict[str, Any]]:
    error, at = state["error"] or (None, None)
    return [
        {
            "stage": state["stage"], "candidates": state["candidates"], "classified": state["classified"], "to_read": len(state["to_read"]), "read_count": state["reads"],
            **{f"{k}_ms": state["timings"].get(k) for k in ("detect", "classify", "read", "merge")},
            "n_notes": state["notes"], "regions": json.dumps({k: state["regions"][k] for k in sorted(state["regions"], key=int)}), "error": error, "error_stage": at,
        }
    ]


def _told(state: State, event: dict[str, Any]) -> tuple[State, list]:
    """Streams tell a request's summary once, at its terminal event."""
    ended = state["ended"]
    state, _ = step(state, event)
    return state, summary(state) if state["ended"] and not ended else []


def _silent(state: State) -> list[dict[str, Any]]:
    """A stream that falls silent without a terminal event is an error."""
    return [] if state["ended"] else summary(step(state, {"type": "error", "t": 0, "error": "TIMEOUT"})[0])


def progress(events: DataFrame) -> DataFrame:
    """The latest summary of every request (request_id, seq, type, t, ...)."""
    return batch_fold(events, "request_id", ["seq"], start, step, SUMMARY, summary)


def progress_stream(events: DataFrame, idle_ms: int) -> DataFrame:
    """Summaries of requests as they end; state is bounded by the idle timeout, which forgets keys."""
    return stream_fold(events, "request_id", ["seq"], start, _told, SUMMARY, idle_ms, _silent)
