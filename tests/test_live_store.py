"""The live store: no batch lost or added twice, newest rows by number, routing against what this run resolved."""

import random

import pytest

from polyview.sources.live_store import LiveStore, routed_stream

SCHEMA = "file string, up int, at long"


def store(spark, tmp_path):
    return LiveStore(spark, f"file://{tmp_path}/store", SCHEMA, "file", "at")


def held(s, version=None):
    return {r.file: (r.up, r.at) for r in s.read(version).collect()}


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_versions(spark, tmp_path):
    s = store(spark, tmp_path)
    assert held(s) == {} and s.compact() is None
    assert s.upsert(rows(spark, ("a", 1, 5), ("a", 2, 4), ("b", 3, 1), (None, 9, 9)), "run", 0) == 0
    assert s.upsert(rows(spark, ("a", 7, 1)), "run", 1) == 1  # a later version wins, whatever its rows' times
    assert s.upsert(rows(spark, ("a", 0, 99)), "run", 1) is None  # the same batch again
    assert s.upsert(rows(spark, ("c", 4, 1)), "other run", 1) == 2
    assert held(s) == {"a": (7, 1), "b": (3, 1), "c": (4, 1)} and held(s, 0) == {"a": (1, 5), "b": (3, 1)}
    gone = spark.createDataFrame([("b", None, 2, True)], SCHEMA + ", removed boolean")
    s.upsert(gone, "run", 2)
    assert held(s) == {"a": (7, 1), "c": (4, 1)}
    assert s.compact() == 4 and s.compact() is None
    s.upsert(rows(spark, ("b", 8, 1)), "run", 3)
    assert held(s) == {"a": (7, 1), "b": (8, 1), "c": (4, 1)} and held(s, 1) == {"a": (7, 1), "b": (3, 1)}
    assert s.upsert(rows(spark, ("z", 8, 1)), "run", 0) is None  # also after the table was compacted


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    stale = one.commits()
    two.upsert(rows(spark, ("a", 1, 1)), "two", 0)
    real = LiveStore.commits
    monkeypatch.setattr(one.log, "entries", lambda: stale)  # as if the other's commit came between
    assert one.upsert(rows(spark, ("b", 2, 1)), "one", 0) == 1
    assert held(two) == {"a": (1, 1), "b": (2, 1)} and [c["version"] for c in real(two)] == [0, 1]


def test_a_torn_batch_is_swept_and_run_again(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)

    def torn(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(s, "_commit", torn)
        with pytest.raises(OSError):
            s.upsert(rows(spark, ("a", 1, 1)), "run", 0)
    assert held(s) == {} and s.sweep() == 1 and s.sweep() == 0
    assert s.upsert(rows(spark, ("a", 1, 1)), "run", 0) == 0 and held(s) == {"a": (1, 1)}


def test_a_stream_that_fails_after_its_commit(spark, tmp_path):
    """The batch is committed, the stream dies before it says so, and runs the batch again after the restart."""
    s, folder = store(spark, tmp_path), tmp_path / "in"
    rnd = random.Random(1)
    want = {}
    for k in range(4):
        part = [(f"f{rnd.randrange(6)}", k, 10 * k + j) for j in range(5)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/batch={k}")
        want |= {f: (u, a) for f, u, a in part}
    ran, fail = [], {2}

    def then(batch, batch_id):
        ran.append(batch_id)
        if batch_id in fail:
            fail.discard(batch_id)
            raise OSError("the driver is lost")

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        return s.sink(stream, "poses", str(tmp_path / "state"), then).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="driver is lost"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert ran == [0, 1, 2, 2, 3] and [c["batch"] for c in s.commits()] == [0, 1, 2, 3]
    assert {f: u for f, (u, _) in held(s).items()} == {f: u for f, (u, _) in want.items()}
    assert spark.read.schema(SCHEMA).parquet(*[f"file://{tmp_path}/store/{c['place']}" for c in s.commits()]).count() == sum(len({r.file for r in spark.read.parquet(f"{folder}/batch={k}").collect()}) for k in range(4))


def test_later_files_see_this_runs_poses(spark, tmp_path):
    from pyspark.sql import functions as F

    from polyview.operators.routing import route

    s, folder = store(spark, tmp_path), tmp_path / "files"

    def decide(batch, poses):
        met = batch.join(poses, "file", "left")
        no = F.lit(False)
        r = route(no, F.col("up").isNotNull(), F.lit(True), no, no, no, no, no, no)
        return met.select("file", r["decision"].alias("decision"))

    def files(k, *names):
        spark.createDataFrame([(n,) for n in names], "file string").coalesce(1).write.parquet(f"{folder}/batch={k}")
        stream = spark.readStream.schema("file string").parquet(f"{folder}/*")
        routed_stream(stream, s, decide, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)

    files(0, "a", "b")
    s.upsert(rows(spark, ("a", 3, 1)), "poses", 0)
    files(1, "a", "c")
    got = sorted((r.batch, r.file, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "a", "PoseRenderTask"), (0, "b", "PoseRenderTask"), (1, "a", "EmbedRenderTask"), (1, "c", "PoseRenderTask")]
