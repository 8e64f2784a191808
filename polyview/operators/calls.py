"""Calls to a paid service from many tasks at one pace, with a second attempt and a way to stop.

Time is cut into slots, ``spacing_s`` apart since the epoch.  Caller i of n starts only in slots whose number leaves i when divided by n, so starts of all
tasks keep the spacing (as far as the machines' clocks agree) and no task needs to ask another.  Speculative execution must be off, and
results are to be written once and not recomputed: a call costs money.  After a lost executor, its partition's calls are made again;
``answered`` keeps out rows that an earlier run has written.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from polyview.operators.routing import REJECTED_REASONS, TRANSIENT_STATUS

#: (status, body) of one call; an exception counts as a call that was never judged.
Call = Callable[[dict], tuple[int | None, str | None]]


def judged(status: int | None, body: str | None) -> str:
    """What ``routing.call_outcome`` says of one reply, for a task's next step."""
    if status in (429, 503):
        return "rate_limited"
    if status is None or status in TRANSIENT_STATUS or status >= 500:
        return "unavailable"
    if status >= 400:
        return "rejected"
    try:
        reply = json.loads(body)
    except (TypeError, ValueError):
        return "unavailable"
    reply = reply if isinstance(reply, dict) else {}
    first = (reply.get("candidates") or [{}])[0]
    feedback = reply.get("promptFeedback") or {}
    if (first.get("content") or {}).get("parts"):
        return "answered"
    return "rejected" if first.get("finishReason") in REJECTED_REASONS or feedback.get("blockReason") is not None else "unavailable"


def next_slot(now: float, last: int, spacing_s: float, caller: int, callers: int) -> int:
    """The first slot of a caller that begins at ``now`` or later, and after the slot ``last``."""
    first = max(math.ceil(now / spacing_s), last + 1)
    return first + (caller - first) % callers


def paced_calls(rows: DataFrame, call: Call, spacing_s: float, callers: int = 4, attempts: int = 2, backoff_s: float = 5.0, stop: Callable[[], bool] = lambda: False, answered: DataFrame | None = None, key: str = "key") -> DataFrame:
    """``rows`` with status, body, outcome, n_calls and started (seconds) of the last attempt.

    A rejected or answered call is not repeated; one refused for its rate waits ``backoff_s`` before the next attempt, others try in the next
    slot.  Where ``stop()`` is true when a call's slot comes, it is not made, and the row's outcome is ``cancelled`` if no attempt was made before.
    Rows whose ``key`` stands in ``answered`` are left out.  Rows keep their columns; those named as results are replaced.
    """
    results = {"status": "int", "body": "string", "outcome": "string", "n_calls": "int", "started": "double"}
    names = [c for c in rows.columns if c not in results]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema] + [f"{c} {t}" for c, t in results.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, last = TaskContext.get().partitionId() % callers, -1

        def one(row: dict) -> tuple:
            nonlocal last
            got = (None, None, "cancelled", 0, None)
            for n in range(1, attempts + 1):
                last = next_slot(time.time(), last, spacing_s, caller, callers)
                time.sleep(max(0.0, last * spacing_s - time.time()))
                if stop():
                    return got
                began = time.time()
                try:
                    status, body = call(row)
                except Exception as e:
                    status, body = None, f"{type(e).__name__}: {e}"
                outcome = judged(status, body)
                got = (status, body, outcome, n, began)
                if outcome in ("answered", "rejected"):
                    break
                if outcome == "rate_limited" and n < attempts:
                    time.sleep(backoff_s)
            return got

        for b in batches:
            for start in range(0, len(b), 16):  # what is paid for goes on soon
                part = b.iloc[start : start + 16]
                got = pd.DataFrame([one(r) for r in part.to_dict("records")], columns=list(results), index=part.index)
                yield pd.concat([part, got.astype({"status": "Int32"})], axis=1)

    open_ = rows.select(names) if answered is None else rows.select(names).join(answered.select(key).distinct(), key, "left_anti").select(names)
    return open_.repartition(callers).mapInPandas(run, fields)
