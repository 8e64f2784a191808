"""A worker that owes results and falls silent: noticed by a timer, also while no events come.

Events (worker, ts, kind, index): ``admitted`` gives the worker a file, ``parked`` takes it off its hands until ``resumed``, ``retired`` ends it, and
``progress`` is any other sign of life.  ``parked``, ``retired`` and ``progress`` are the worker's own messages and restart its clock; admissions and
resumptions do so only if it owed nothing, as there is nothing to measure then.  A worker that owes a file and has been silent for
longer than ``stall_s`` has stalled: every file it still has is reported once, and it counts as gone; what it is given later fails at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "worker string, ts timestamp, kind string, index long"
FAILURES = "worker string, index long, at timestamp, parked boolean"
_SIGNS = ("parked", "retired", "progress")
_RANK = {k: n for n, k in enumerate(("admitted", "progress", "parked", "resumed", "retired"))}


class _Stalls(StatefulProcessor):
    def __init__(self, stall_s: float, fail_parked: bool, event_time: bool):
        self.stall_ms, self.fail_parked, self.event_time = int(stall_s * 1000), fail_parked, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "index long", "parked boolean")  # admitted and not retired
        self.clock = handle.getValueState("clock", "last long, owed long, gone long")

    def _stalled(self, worker: str, at: int) -> list[tuple]:
        """Every file of the worker that must fail; under ``fail_parked`` false a parked file needs no worker any more and stays."""
        out = []
        for (index,), (parked,) in sorted(self.files.iterator()):
            if self.fail_parked or not parked:
                out.append(_row(worker, index, at, parked))
                self.files.removeKey((index,))
        return out

    def _state(self) -> tuple[int, int, int]:
        return self.clock.get() if self.clock.exists() else (0, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        events = sorted(zip(batch["ts"], [_RANK.get(k, 9) for k in batch["kind"]], batch["kind"], batch["index"]), key=lambda e: (e[0], e[1], -1 if pd.isna(e[3]) else e[3]))
        last, owed, gone = self._state()
        out = []
        for ts, _, kind, index in events:
            at = int(ts.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if owed and not gone and at > last + self.stall_ms:  # the timer is due, though it has not fired
                gone, owed = last + self.stall_ms, 0
                out += self._stalled(key[0], gone)
            file = None if pd.isna(index) else (int(index),)
            known = file is not None and self.files.containsKey(file)
            parked = known and self.files.getValue(file)[0]
            if kind in ("admitted", "resumed") and owed == 0:
                last = at
            if kind in _SIGNS:
                last = at
            if kind == "admitted" and file and not known:
                if gone:
                    out.append(_row(key[0], file[0], at, False))
                else:
                    self.files.updateValue(file, (False,))
                    owed += 1
            elif kind == "parked" and known and not parked:
                self.files.updateValue(file, (True,))
                owed -= 1
            elif kind == "resumed" and known and parked:
                if gone:
                    self.files.removeKey(file)
                    out.append(_row(key[0], file[0], at, True))
                else:
                    self.files.updateValue(file, (False,))
                    owed += 1
            elif kind == "retired" and known:
                self.files.removeKey(file)
                owed -= 0 if parked or gone else 1
        self.clock.update((last, owed, gone))
        if owed and not gone:
            self.handle.registerTimer(last + self.stall_ms + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, owed, gone = self._state()
        out = []
        if owed and not gone:
            if expiredTimerInfo.getExpiryTimeInMs() > last + self.stall_ms:
                at = last + self.stall_ms
                out = self._stalled(key[0], at)
                self.clock.update((last, 0, at))
            else:
                self.handle.registerTimer(last + self.stall_ms + 1)
        yield _frame(out)


def _row(worker: str, index: int, at_ms: int, parked: bool) -> tuple:
    return worker, index, datetime.fromtimestamp(at_ms / 1000, timezone.utc).replace(tzinfo=None), parked


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["worker", "index", "at", "parked"]).astype({"index": "int64", "at": "datetime64[us]", "parked": "bool"})


def stalled_files(events: DataFrame, stall_s: float = 240, fail_parked: bool = True, event_time: bool = False, late: str = "10 minutes") -> DataFrame:
    """A row for every file that a stalled worker cannot finish.  Silence is measured by the clock, or with ``event_time`` by the watermark.

    ``fail_parked`` is false where a parked file needs nothing further of its worker.  Needs the RocksDB state store.
    """
    known = events.filter("worker IS NOT NULL")
    if event_time:
        known = known.withWatermark("ts", late)
    return known.groupBy("worker").transformWithStateInPandas(_Stalls(stall_s, fail_parked, event_time), FAILURES, "Append", "EventTime" if event_time else "ProcessingTime")
