"""Stateful pipeline accounting over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from polyview.operators.routing import COUNTED, HEALTHY


def circuit_breaker(log: DataFrame, failures: int = 5, span_s: int = 60, late: str = "1 hour") -> DataFrame:
    """One row when a user's breaker trips: enough consecutive failures over a long enough time.  It never untrips.

    Answers and rejections reset the count, unavailable and failed calls count, cancelled ones do neither.  A user's calls of a
    micro-batch are taken in order of time, over all chunks in which they arrive; calls later than ``late`` are dropped by the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, since, tripped = state.get if state.exists else (0, 0.0, False)
        out = []
        rows = pd.concat([b[["ts", "event_id", "outcome"]] for b in batches], ignore_index=True)
        for ts, outcome in rows.sort_values(["ts", "event_id"])[["ts", "outcome"]].itertuples(index=False):
            at = ts.timestamp()
            if outcome in HEALTHY:
                count = 0
            elif outcome in COUNTED:
                since = at if count == 0 else since
                count += 1
                if not tripped and count >= failures and at - since >= span_s:
                    tripped = True
                    out.append((key[0], ts))
        state.update((count, since, tripped))
        yield pd.DataFrame(out, columns=["user_id", "tripped_at"])

    kept = log.withWatermark("ts", late)
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, tripped_at timestamp", "count int, since double, tripped boolean", "append", GroupStateTimeout.NoTimeout)


def stashed(tiles: DataFrame, embeds: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tiles wait for the embeddings of the same index: a stream-stream join whose state the watermarks bound."""
    a, b = tiles.withWatermark("ts", late).alias("t"), embeds.withWatermark("ts", late).alias("e")
    near = F.expr(f"t.index = e.index AND e.ts >= t.ts AND e.ts <= t.ts + interval {late}")
    return a.join(b, near).select("t.index", "t.file", "e.embedding")


def retire_once(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first retirement of each index within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["index"])


def tumbling_counts(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: outcomes per window."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "outcome").count()
