"""Parked poses: every way to be settled, over micro-batches, by events' times and by the clock."""

import datetime
import random
import time

import duckdb
import pytest

from polyview.plans.registry import ORACLES, QUERIES
from polyview.streaming.parking import EVENTS, RECORDS, settle_log, settle_stream


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def pose(index, second, gated=True, up=2, source="geometry"):
    return (index, at(second), "resolved", up, 0.5, source, 0.01, gated, None, None)


def call(index, second, outcome, tile=None):
    return (index, at(second), "call", None, None, None, None, None, outcome, tile)


def drop(index, second):
    return (index, at(second), "drop", None, None, None, None, None, None, None)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={k}")


def start(spark, folder, tmp_path, name, trigger, **more):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return settle_stream(stream, **more).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(**trigger).start()


EVERY = [
    pose(1, 0), call(1, 5, "answer", 4), pose(2, 0, source="siglip"), call(2, 5, "answer", 2), pose(3, 0), call(3, 5, "answer"), pose(4, 0), call(4, 5, "rejected"),
    pose(5, 0), call(5, 5, "unavailable"), pose(6, 0), call(6, 5, "cancelled"), pose(7, 0), pose(8, 0), call(8, 70, "answer", 1), pose(9, 0, gated=False), call(9, 5, "answer", 1),
    call(10, 0, "answer", 3), pose(10, 20), pose(11, 0), drop(11, 3), call(11, 5, "answer", 3), drop(12, 1), pose(12, 2), pose(13, 0), call(13, 5, "failed"), call(13, 6, "answer", 0),
    pose(14, 0), pose(14, 1, up=5), call(14, 60, "answer", 2), pose(15, 0), drop(15, 80), (None, at(0), "drop", *[None] * 7), call(16, 0, "answer", 1),
]
WANT = {
    1: ("folded", 4, "vlm", "true", True), 2: ("folded", 2, "siglip", "true", True), 3: ("folded", 2, "geometry", "false", False), 4: ("folded", 2, "geometry", "rejected", False),
    5: ("folded", 2, "geometry", "false", False), 6: ("resumed", 2, "geometry", "false", False), 7: ("abandoned", 2, "geometry", "false", False), 8: ("abandoned", 2, "geometry", "false", False),
    9: ("resolved", 2, "geometry", None, False), 10: ("folded", 3, "vlm", "true", True), 11: ("dropped", None, None, None, None), 12: ("dropped", None, None, None, None),
    13: ("folded", 2, "geometry", "false", False), 14: ("folded", 2, "geometry", "true", False), 15: ("abandoned", 2, "geometry", "false", False),
}


def ends(rows):
    got = [(r["index"], (r.event, r.up, r.source, r.arbitrated, r.pose_changed)) for r in rows if r.event not in ("parked", "late")]
    assert len(got) == len(dict(got))
    return dict(got)


def test_a_whole_log(spark):
    assert ends(settle_log(spark.createDataFrame(EVERY, EVENTS)).collect()) == WANT


def test_every_pose_of_a_repeated_index_is_settled(spark):
    """By the first end and drop of the index; an index with only a drop stays, one with only an end does not come."""
    log = [pose(1, 0), pose(1, 3, up=4), pose(1, 3, up=4), pose(1, 9, gated=False), call(1, 5, "answer", 4), call(1, 6, "rejected"), drop(2, 1), call(3, 1, "answer", 2)]
    rows = settle_log(spark.createDataFrame(log, EVENTS), every_pose=True).collect()
    confirmed = (1, at(5), "folded", 4, "geometry", "true", False)
    want = [(1, at(5), "folded", 4, "vlm", "true", True), confirmed, confirmed, (1, at(9), "resolved", 2, "geometry", None, False), (2, at(1), "dropped", None, None, None, None)]
    assert sorted(((r["index"], r["at"], r.event, r.up, r.source, r.arbitrated, r.pose_changed) for r in rows), key=repr) == sorted(want, key=repr)


def test_ends_at_one_time_go_by_their_place_in_the_log(spark):
    """Not by the alphabet of their outcomes; one without a time is the last."""
    log = [pose(1, 0), (1, None, "call", *[None] * 5, "answer", 5), call(1, 5, "rejected"), call(1, 5, "answer", 4), pose(2, 0), call(2, 5, "answer", 4), call(2, 5, "rejected"), pose(3, 0), (3, None, *drop(3, 0)[2:]), drop(3, 4)]
    events = spark.createDataFrame([(*r, k) for k, r in enumerate(log)], EVENTS + ", place int")
    want = {1: ("folded", 2, "geometry", "rejected", False), 2: ("folded", 4, "vlm", "true", True), 3: ("dropped", None, None, None, None)}
    assert ends(settle_log(events, seq="place").collect()) == want


def test_the_query_equals_its_sql_on_odd_events(spark, tmp_path):
    """Ids that repeat, as where copies of a table meet, or are missing or negative; types and times that are missing, times before 1970; no two at one time."""
    rnd = random.Random(6)
    ids = [*range(-8, 1200), *rnd.choices(range(1200), k=400), *[40] * 50, None]
    rows = [(i, at((i or 0) * 30 + n / 1000 - (2 * 10**9 if n % 11 == 0 else 0)), rnd.randrange(9), rnd.choice(["view", "click", "error", "signup", "purchase", None]), rnd.random(), None) for n, i in enumerate(ids)]
    rows = [(r[0], None, *r[2:]) if rnd.random() < 0.1 else r for r in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES["r06_settle_log"])
    names = [c[0] for c in want.description]
    got = QUERIES["r06_settle_log"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_a_stream_by_its_own_time_equals_the_log(rocks, tmp_path, batches):
    """Also on random events, whatever the cut into micro-batches."""
    rnd = random.Random(batches)
    more = [f for i in range(100, 160) for f in rnd.sample([pose(i, rnd.randrange(90)), pose(i, rnd.randrange(90), gated=rnd.random() < 0.5), call(i, rnd.randrange(90), rnd.choice(["answer", "rejected", "failed", "cancelled"]), rnd.choice([None, 2, 3])), call(i, rnd.randrange(90), "answer", 1), drop(i, rnd.randrange(90))], rnd.randrange(1, 6))]
    # ties in time between events of one kind have no order
    seen, events = set(), []
    for e in EVERY + more:
        if (e[0], e[1], e[2]) not in seen:
            seen.add((e[0], e[1], e[2]))
            events.append(e)
    order = sorted(events, key=lambda e: e[1])
    folder = tmp_path / "events"
    for k in range(batches):
        write(rocks, folder, k, order[k * len(order) // batches : (k + 1) * len(order) // batches])
    write(rocks, folder, batches, [drop(10**6, 5000)])  # moves the watermark beyond every wait
    write(rocks, folder, batches + 1, [drop(10**6 + 1, 5001)])
    q = start(rocks, folder, tmp_path, f"parked{batches}", {"availableNow": True}, event_time=True, late="1 second", forget_s=100000)
    q.awaitTermination(180)
    rows = rocks.table(f"parked{batches}").collect()
    got = {i: r for i, r in ends(rows).items() if i < 10**6}
    want = ends(settle_log(rocks.createDataFrame(events, EVENTS)).collect())
    assert got == want and {k: got[k] for k in WANT} == WANT
    when = {r["index"]: r["at"] for r in settle_log(rocks.createDataFrame(events, EVENTS)).collect()}
    assert {r["index"]: r["at"] for r in rows if r.event not in ("parked", "late") and r["index"] < 10**6} == when
    parked = [r for r in rows if r.event == "parked"]
    assert parked and all(r.arbitrated == "false" for r in parked)


def test_the_clock_settles_a_silent_stream_and_late_answers_change_nothing(rocks, tmp_path):
    folder = tmp_path / "events"
    write(rocks, folder, 0, [pose(1, 0), pose(2, 0), call(2, 1, "answer", 5)])
    q = start(rocks, folder, tmp_path, "clock", {"processingTime": "1 second"}, wait_s=3)
    try:
        began = time.time()
        while time.time() - began < 60 and 1 not in {r["index"] for r in rocks.table("clock").collect() if r.event == "abandoned"}:
            time.sleep(0.5)  # no events: only the timer can settle index 1
        write(rocks, folder, 1, [call(1, 2, "answer", 4), call(2, 3, "rejected")])
        while time.time() - began < 90 and len([r for r in rocks.table("clock").collect() if r.event == "late"]) < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    rows = rocks.table("clock").collect()
    assert ends(rows) == {1: ("abandoned", 2, "geometry", "false", False), 2: ("folded", 5, "vlm", "true", True)}
    assert sorted((r["index"], r.event) for r in rows if r.event in ("parked", "late")) == [(1, "late"), (1, "parked"), (2, "late"), (2, "parked")]


def test_a_restart_keeps_what_is_parked(rocks, tmp_path):
    """Stopped and started again, on the same checkpoint; the pose that was parked before is folded after."""
    folder, out = tmp_path / "events", str(tmp_path / "out")

    def until(event):
        stream = rocks.readStream.schema(EVENTS).parquet(f"{folder}/*")
        q = settle_stream(stream, wait_s=600).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "again-state")).trigger(processingTime="1 second").start()
        began, rows = time.time(), []
        try:
            while time.time() - began < 60 and event not in {r.event for r in rows}:
                time.sleep(0.5)
                rows = rocks.read.schema(RECORDS).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata" / "0").exists() else []
        finally:
            q.stop()
        return rows

    write(rocks, folder, 0, [pose(1, 0)])
    assert [r.event for r in until("parked")] == ["parked"]
    write(rocks, folder, 1, [call(1, 2, "answer", 4)])
    assert ends(until("folded")) == {1: ("folded", 4, "vlm", "true", True)}
