"""Stalled workers, by events' times against a plain loop, and by the clock in a silent stream."""

import datetime
import random
import time

import pytest

from polyview.streaming.stalls import EVENTS, stalled_files


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def plain(events, stall, fail_parked, end):
    """Second by second."""
    out, files, last, gone = [], {}, 0, False
    by = {}
    for e in events:
        by.setdefault(e[0], []).append(e)
    rank = ["admitted", "progress", "parked", "resumed", "retired"]
    for second in range(end):
        owed = [i for i, p in files.items() if not p]
        if owed and not gone and second > last + stall:
            gone = True
            for i in sorted(files):
                if fail_parked or not files[i]:
                    out.append((i, last + stall, files[i]))
            files = {i: p for i, p in files.items() if not (fail_parked or not p)}
        for _, kind, i in sorted(by.get(second, []), key=lambda e: (rank.index(e[1]), e[2])):
            owed = [] if gone else [j for j, p in files.items() if not p]
            if kind in ("parked", "retired", "progress") or kind in ("admitted", "resumed") and not owed:
                last = second
            if kind == "admitted" and i not in files:
                if gone:
                    out.append((i, second, False))
                else:
                    files[i] = False
            elif kind == "parked" and i in files:
                files[i] = True
            elif kind == "resumed" and files.get(i):
                if gone:
                    out.append((i, second, True))
                    del files[i]
                else:
                    files[i] = False
            elif kind == "retired":
                files.pop(i, None)
    return out


@pytest.mark.parametrize("fail_parked", [True, False])
def test_against_a_plain_loop(rocks, tmp_path, fail_parked):
    rnd = random.Random(5)
    logs = {f"w{k}": [(rnd.randrange(300), rnd.choice(["admitted", "admitted", "parked", "resumed", "retired", "progress"]), rnd.randrange(8)) for _ in range(rnd.randrange(2, 25))] for k in range(25)}
    logs["idle"] = [(0, "admitted", 1), (5, "retired", 1), (200, "admitted", 2), (230, "progress", 2), (235, "retired", 2)]
    logs["tail"] = [(0, "admitted", 1), (5, "parked", 1), (250, "resumed", 1), (290, "retired", 1)]
    rows = [(w, at(s), kind, i) for w, events in logs.items() for s, kind, i in events] + [(None, at(1), "admitted", 1)]
    # equal events have no order between them
    rows = sorted(set(rows), key=lambda r: (r[1], str(r)))
    folder = tmp_path / "events"
    parts = [rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3] for k in range(3)] + [[("end", at(5000), "progress", None)], [("end", at(5001), "progress", None)]]
    for k, part in enumerate(parts):
        rocks.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{folder}/batch={k}")
    stream = rocks.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = stalled_files(stream, 40, fail_parked, event_time=True, late="1 second").writeStream.format("memory").queryName(f"stalls{fail_parked}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.worker, r["index"], r["at"], r.parked) for r in rocks.table(f"stalls{fail_parked}").collect())
    want = sorted((w, i, at(s), p) for w, events in logs.items() for i, s, p in plain(sorted(set(events)), 40, fail_parked, 600))
    assert got == want and len(want) > 20 and not [r for r in got if r[0] == "idle" or r[0] == "tail" and r[2] < at(250)]


def test_a_silent_stream(rocks, tmp_path):
    folder = tmp_path / "events"
    rocks.createDataFrame([("a", at(0), "admitted", 7), ("a", at(0), "admitted", 8), ("a", at(1), "retired", 8), ("b", at(0), "admitted", 9), ("b", at(1), "parked", 9)], EVENTS).coalesce(1).write.parquet(f"{folder}/batch=0")
    stream = rocks.readStream.schema(EVENTS).parquet(f"{folder}/*")
    q = stalled_files(stream, 2).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        began = time.time()
        while time.time() - began < 60 and not rocks.table("silent").count():
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.worker, r["index"], r.parked) for r in rocks.table("silent").collect()] == [("a", 7, False)]
