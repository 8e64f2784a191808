"""Streams over files: the breaker, retirement, stashed tiles."""

import datetime

from polyview.streaming.breaker import circuit_breaker, retire_once, stashed


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def run(spark, tmp_path, name, schema, batches, query):
    """Rows of ``query`` over a folder of files, one micro-batch a file."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = query(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_breaker_counts_over_batches(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, outcome string"
    calls = lambda user, first, outcomes: [(user, first + k, at(first + k), o) for k, o in enumerate(outcomes)]
    bad = ["unavailable", "failed"]
    one = calls(1, 0, bad + ["cancelled"] + bad) + calls(2, 0, bad + ["rejected"] + bad) + calls(3, 0, bad * 2) + calls(4, 0, bad * 5)
    two = calls(1, 5, bad) + calls(2, 5, bad) + calls(3, 4, ["answer"] + bad * 2) + calls(4, 10, bad * 5)
    got = run(spark, tmp_path, "breaker", schema, [one[::-1], two[::-1]], circuit_breaker)
    assert sorted((r.user_id, r.tripped_at) for r in got) == [(1, at(5)), (4, at(4))]


def test_a_burst_does_not_trip(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, outcome string"
    assert run(spark, tmp_path, "burst", schema, [[(1, k, at(0), "failed") for k in range(50)]], circuit_breaker) == []


def test_retirement_once(spark, tmp_path):
    schema = "index long, ts timestamp"
    got = run(spark, tmp_path, "retired", schema, [[(1, at(0)), (2, at(0))], [(1, at(1)), (3, at(1))]], retire_once)
    assert sorted(r["index"] for r in got) == [1, 2, 3]


def test_stashed_tiles_meet_their_embeddings(spark, tmp_path):
    schema = "index long, ts timestamp, file string, embedding double"

    def query(stream):
        return stashed(stream.filter("file is not null").select("index", "ts", "file"), stream.filter("embedding is not null").select("index", "ts", "embedding"))

    batches = [[(1, at(0), "a", None), (2, at(0), "b", None)], [(1, at(3), None, 0.5), (2, at(30), None, 0.7)]]
    assert [tuple(r) for r in run(spark, tmp_path, "stash", schema, batches, query)] == [(1, "a", 0.5)]
