"""Deferred answers: an uncertain pose is parked while its call is out, and folded, abandoned or dropped later.

Events (index, ts, kind, ...) come in any order:

* ``resolved``: the ensemble's pose (up, ratio, source, margin) and whether it is ``gated`` (its margin asks for a second opinion).  One that
  is not gated is final.  A gated one is recorded at once as not arbitrated, and parked.
* ``call``: how the call ended.  ``answer`` with a tile settles the pose, moved or confirmed; an answer without a tile, ``unavailable``,
  ``failed`` and ``cancelled`` keep the pose and leave it open to a later run; ``rejected`` keeps it for good.
* ``drop``: the file has failed; what is parked is forgotten, and its call's end is not waited for.

A parked pose whose call has not ended ``wait`` seconds after it is abandoned: it keeps its pose, not arbitrated.  The first end of a call counts,
also one that arrives before the pose; one that comes after the file was settled changes nothing and is reported as ``late``.  A second
``resolved`` of a known index is ignored.  Events without an index are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "index long, ts timestamp, kind string, up int, ratio double, source string, margin double, gated boolean, outcome string, tile int"
RECORDS = "index long, at timestamp, event string, up int, ratio double, source string, margin double, arbitrated string, pose_changed boolean"
#: Sources whose pose is not the geometry's own.
MOVED = ["siglip", "vlm"]
_POSE = ["up", "ratio", "source", "margin"]
_RANK = {"resolved": 0, "drop": 1, "call": 2}


class _Parking(StatefulProcessor):
    """The state of one index: what is parked, the end of a call that came first, and whether the file is settled."""

    def __init__(self, wait_s: float, forget_s: float, event_time: bool):
        self.wait_ms, self.forget_ms, self.event_time = int(wait_s * 1000), int(forget_s * 1000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parked = handle.getValueState("parked", "up int, ratio double, source string, margin double, deadline long")
        self.ended = handle.getValueState("ended", "outcome string, tile int")
        self.settled = handle.getValueState("settled", "at long")

    def _row(self, index, at_ms, event, pose, arbitrated) -> tuple:
        at = datetime.fromtimestamp(at_ms / 1000, timezone.utc).replace(tzinfo=None)
        return (index, at, event, *pose, arbitrated, None if pose[2] is None else pose[2] in MOVED)

    def _settle(self, at_ms: int) -> None:
        self.parked.clear()
        self.ended.clear()
        self.settled.update((at_ms,))
        self.handle.registerTimer(at_ms + self.forget_ms)

    def _fold(self, index, at_ms: int, pose: tuple, outcome: str, tile: int | None) -> tuple:
        up, ratio, source, margin = pose
        arbitrated = "rejected" if outcome == "rejected" else "true" if outcome == "answer" and tile is not None else "false"
        if arbitrated == "true" and tile != up:
            up, source = tile, "vlm"
        self._settle(at_ms)
        return self._row(index, at_ms, "resumed" if outcome == "cancelled" else "folded", (up, ratio, source, margin), arbitrated)

    def _abandon(self, index, pose: tuple, deadline: int) -> tuple:
        self._settle(deadline)
        return self._row(index, deadline, "abandoned", pose, "false")

    def _step(self, index, at: int, r: dict) -> Iterator[tuple]:
        known = self.parked.get() if self.parked.exists() else None
        if known and at > known[4]:  # the timer is due, though it has not fired
            yield self._abandon(index, known[:4], known[4])
            known = None
        if r["kind"] == "drop":
            if not self.settled.exists():
                self._settle(at)
                yield self._row(index, at, "dropped", (None,) * 4, None)
        elif r["kind"] == "resolved":
            if known or self.settled.exists():
                return
            pose = tuple(r[c] for c in _POSE)
            if not r["gated"]:
                self._settle(at)
                yield self._row(index, at, "resolved", pose, None)
                return
            yield self._row(index, at, "parked", pose, "false")
            if self.ended.exists():
                yield self._fold(index, at, pose, *self.ended.get())
            else:
                self.parked.update((*pose, at + self.wait_ms))
                self.handle.registerTimer(at + self.wait_ms)
        elif r["kind"] == "call":
            if known:
                yield self._fold(index, at, known[:4], r["outcome"], r["tile"])
            elif self.settled.exists():
                yield self._row(index, at, "late", (None,) * 4, None)
            elif not self.ended.exists():
                self.ended.update((r["outcome"], r["tile"]))
                self.handle.registerTimer(at + self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.iloc[sorted(range(len(batch)), key=lambda k: (batch["ts"][k], _RANK.get(batch["kind"][k], 3)))]
        batch = batch.astype(object).where(batch.notna(), None)
        out = []
        for r in batch.to_dict("records"):
            at = int(r["ts"].timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            r["up"], r["tile"] = (None if r[c] is None else int(r[c]) for c in ("up", "tile"))
            out += self._step(key[0], at, r)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.parked.exists() and now >= self.parked.get()[4]:
            pose = self.parked.get()
            out.append(self._abandon(key[0], pose[:4], pose[4]))
        elif self.settled.exists() and now >= self.settled.get()[0] + self.forget_ms:
            self.settled.clear()
        elif self.ended.exists() and not self.parked.exists():
            self.ended.clear()
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["index", "at", "event", *_POSE, "arbitrated", "pose_changed"])
    return out.astype({"up": "Int32", "ratio": "float64", "margin": "float64", "pose_changed": "boolean", "at": "datetime64[us]"})


def settle_stream(events: DataFrame, wait_s: float = 60, forget_s: float = 3600, event_time: bool = False, late: str = "10 minutes") -> DataFrame:
    """Records of a stream of ``EVENTS``, as they are made: the parked pose first, then how it was settled.

    By default waiting is by the clock, with timers that also fire while no events come; with ``event_time`` it is by the events' own
    times and the watermark, as in ``settle_log``.  State of a settled file is kept for ``forget_s`` seconds.  Needs the RocksDB state store.
    """
    known = events.filter("index IS NOT NULL")
    if event_time:
        known = known.withWatermark("ts", late)
    mode = "EventTime" if event_time else "ProcessingTime"
    return known.groupBy("index").transformWithStateInPandas(_Parking(wait_s, forget_s, event_time), RECORDS, "Append", mode)


def settle_log(events: DataFrame, wait_s: float = 60, seq: str | None = None, every_pose: bool = False) -> DataFrame:
    """How every resolved or dropped file of a whole log was settled: the records of ``settle_stream`` without parked and late ones.

    Of ends (or poses) at one time the one with the smallest ``seq``, a column of the log, is the first; without it their order is open.  Ends and
    drops without a time come after those with one.  With ``every_pose`` a second ``resolved`` of an index is not ignored: each is settled by
    itself, by the first end and the first drop of its index.

    Aggregates keep one row a file before anything meets, so a file with many events is no hot group; with ``every_pose`` that row meets its poses.
    """
    key = [F.col("ts").isNull().alias("timeless"), F.col("ts"), *([F.col(seq).alias("seq")] if seq else [])]
    first = lambda kind, *cols: F.min(F.when(F.col("kind") == kind, F.struct(*key, *cols)))
    known = events.filter("index IS NOT NULL")
    ends = [first("call", "outcome", "tile").alias("c"), first("drop").alias("d")]
    if every_pose:
        poses = known.filter("kind = 'resolved'").select("index", F.struct("ts", "gated", *_POSE).alias("r"))
        one = known.groupBy("index").agg(*ends).join(poses, "index", "left")
    else:
        one = known.groupBy("index").agg(first("resolved", "gated", *_POSE).alias("r"), *ends)
    wait = F.make_dt_interval(secs=F.lit(float(wait_s)))
    gated = F.coalesce("r.gated", F.lit(False))
    # a call's end waits for its pose; a file is settled at the first of these times
    ended = F.when(F.col("c.ts") <= F.col("r.ts") + wait, F.greatest("c.ts", "r.ts"))
    due = F.when(gated, F.coalesce(ended, F.col("r.ts") + wait)).otherwise(F.col("r.ts"))
    # at one time a pose comes before a drop, and a drop before the end of a call
    before_due = F.when(gated & ~F.coalesce(F.col("c.ts") <= F.col("r.ts"), F.lit(False)), F.col("d.ts") <= due).otherwise(F.col("d.ts") < F.col("r.ts"))
    dropped = F.col("d.ts").isNotNull() & (F.col("r.ts").isNull() | before_due)
    outcome, tile = F.col("c.outcome"), F.col("c.tile")
    answered = gated & ended.isNotNull() & (outcome == "answer") & tile.isNotNull()
    moved = F.coalesce(answered & (tile != F.col("r.up")), F.lit(False))
    event = F.when(dropped, "dropped").when(~gated, "resolved").when(ended.isNull(), "abandoned").when(outcome == "cancelled", "resumed").otherwise("folded")
    arbitrated = F.when(gated, F.when(ended.isNotNull() & (outcome == "rejected"), "rejected").when(answered, "true").otherwise("false"))
    live = lambda c: F.when(~dropped, c)
    source = live(F.when(moved, "vlm").otherwise(F.col("r.source")))
    rows = one.filter("r IS NOT NULL OR d IS NOT NULL")
    return rows.select("index", F.when(dropped, F.col("d.ts")).otherwise(due).alias("at"), event.alias("event"), live(F.when(moved, tile).otherwise(F.col("r.up"))).alias("up"), live(F.col("r.ratio")).alias("ratio"), source.alias("source"), live(F.col("r.margin")).alias("margin"), live(arbitrated).alias("arbitrated"), source.isin(MOVED).alias("pose_changed"))
