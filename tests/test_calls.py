"""Calls at one pace over all tasks, their second attempts, and stopping."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from polyview.operators.calls import judged, next_slot, paced_calls
from polyview.operators.routing import call_outcome

ANSWER = json.dumps({"candidates": [{"content": {"parts": [{"text": '{"tile": 2}'}]}, "finishReason": "STOP"}]})
BLOCKED = json.dumps({"candidates": [{"finishReason": "SAFETY"}]})
REPLIES = [(200, ANSWER), (200, BLOCKED), (200, json.dumps({"promptFeedback": {"blockReason": "OTHER"}})), (200, json.dumps({"candidates": [{"finishReason": "MAX_TOKENS"}]})), (200, "torn {"), (200, None), (200, "{}"), (200, json.dumps({"candidates": []})), (200, json.dumps({"candidates": [{"content": {"parts": []}, "finishReason": "RECITATION"}]})), (429, None), (503, "x"), (404, "x"), (408, None), (500, None), (400, "no"), (None, None)]


def test_one_rule_in_both_forms(spark):
    df = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(REPLIES)], "i int, status int, body string")
    assert {r.i: r.o for r in df.select("i", call_outcome(F.col("status"), F.col("body")).alias("o")).collect()} == {i: judged(s, b) for i, (s, b) in enumerate(REPLIES)}


def test_slots():
    for callers in (1, 3):
        slots = [next_slot(100.2, last, 0.5, i, callers) for i in range(callers) for last in (-1, 205, 300)]
        assert len(set(slots)) == len(slots) and min(slots) * 0.5 >= 100.2 and {s % callers for s in slots} == set(range(callers))


@pytest.fixture()
def calls(tmp_path):
    """A fake service that writes down when each call starts, for whom."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def call(row):
        at = time.time()
        with open(folder / f"{row['key']}-{time.time_ns()}", "w") as f:
            f.write(repr(at))
        n = sum(p.startswith(f"{row['key']}-") for p in os.listdir(folder))
        plan = {0: [(200, ANSWER)], 1: [(None, None), (200, ANSWER)], 2: [(400, "no")], 3: [(500, None), (500, None)], 4: [(429, None), (200, ANSWER)]}
        if row["key"] % 6 == 5:
            raise TimeoutError("slow")
        status, body = plan[row["key"] % 6][n - 1]
        return status, body

    return folder, call


def test_the_pace_holds_over_all_tasks(spark, tmp_path, calls):
    folder, call = calls
    rows = spark.range(24).selectExpr("id AS key", "'x' AS status", "id * 2 AS payload")
    out = paced_calls(rows, call, spacing_s=0.2, callers=4, backoff_s=0.5)
    out.write.parquet(str(tmp_path / "out"))
    got = {r.key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {0: ("answered", 1, 200), 1: ("answered", 2, 200), 2: ("rejected", 1, 400), 3: ("unavailable", 2, 500), 4: ("answered", 2, 200), 5: ("unavailable", 2, None)}
    assert {k: (r.outcome, r.n_calls, r.status) for k, r in got.items()} == {k: want[k % 6] for k in range(24)}
    assert all(r.payload == 2 * k for k, r in got.items())
    starts = sorted(float((folder / p).read_text()) for p in os.listdir(folder))
    assert len(starts) == 4 * (1 + 2 + 1 + 2 + 2 + 2)
    gaps = [b - a for a, b in zip(starts, starts[1:])]
    assert min(gaps) > 0.2 - 0.08  # a slot's start may come late by the time a process needs to wake up
    first, second = (sorted(float((folder / p).read_text()) for p in os.listdir(folder) if p.startswith("4-")))
    assert second - first >= 0.5
    again = paced_calls(rows, call, spacing_s=0.2, answered=spark.read.parquet(str(tmp_path / "out")).filter("outcome IN ('answered', 'rejected')"))
    assert {r.key % 6 for r in again.collect()} == {3, 5}


def test_stopping(spark, tmp_path, calls):
    folder, call = calls
    flag = tmp_path / "stop"

    def first_then_stop(row):
        flag.touch()
        return call(row)

    rows = spark.range(0, 60, 6).withColumnRenamed("id", "key")
    got = paced_calls(rows, first_then_stop, spacing_s=0.1, callers=1, stop=flag.exists).collect()
    assert sorted(r.outcome for r in got) == ["answered"] + ["cancelled"] * 9 and len(os.listdir(folder)) == 1
    assert {r.n_calls for r in got if r.outcome == "cancelled"} == {0}
