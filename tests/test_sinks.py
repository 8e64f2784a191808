"""Written results, and the text forms of keys."""

from pyspark.sql import functions as F


def test_results_csv(spark, tmp_path):
    from polyview.sources.sinks import RESULT_COLUMNS, write_results

    rows = [(2, "b", None, [("cat", 0.5), ("dog", 0.25)], "0,0,1", 0.9, "geometry", 3), (1, "a", "torn", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "index int, file string, error string, top array<struct<category string, score double>>, up string, pose_conf double, pose_source string, front_view int")
    for _ in range(2):  # rewritten whole
        write_results(df, f"{tmp_path}/r")
    got = spark.read.option("header", True).csv(f"{tmp_path}/r")
    assert got.columns == RESULT_COLUMNS and got.count() == 2
    a, b = got.orderBy("file").collect()
    assert a["top1"] == "RENDER_ERROR: torn" and a["up"] is None
    assert (b["top1"], b["score2"], b["top3"], b["front_view"]) == ("cat", "0.25", None, "3")


def test_snapshots_and_reports(spark, tmp_path):
    from polyview.sources.sinks import read_snapshot, write_clusters, write_report, write_snapshot

    base = f"{tmp_path}/poses"
    write_snapshot(spark.range(3), base)
    write_snapshot(spark.range(5), base)
    assert read_snapshot(spark, base).count() == 5
    write_report(spark.range(2), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    write_clusters(spark.createDataFrame([("x", 1, 0.123456)], "file string, cluster int, centroid_dist double"), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["centroid_dist"] == "0.1235"


def test_number_text(spark):
    from polyview.operators.identity import general_number

    values = [0.0, -0.0, 1.0, -1.0, 20.0, 100.0, 0.5, 1 / 3, 123456.7, 1234567.0, 1e-4, 1.5e-5, -10.0, 100000.0, 999999.5, 1e10, 0.70710678]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(general_number(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:g}" for v in values]


def test_stamp_store_and_restore_plan(spark, tmp_path):
    from polyview.sources.sinks import append_embeddings, read_snapshot, restore_plan, write_stamp

    for version in (3, 4):
        write_stamp(spark, f"{tmp_path}/stamp", version, "keys")
    assert read_snapshot(spark, f"{tmp_path}/stamp").first()["version"] == 4
    row = "embed_key string, view int, embedding array<float>"
    append_embeddings(spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("a", 1, [2.0])], row), f"{tmp_path}/e")
    append_embeddings(spark.createDataFrame([("a", 0, [9.0]), ("b", 0, [3.0])], row), f"{tmp_path}/e")
    got = sorted((r.embed_key, r.view, r.embedding[0]) for r in spark.read.parquet(f"{tmp_path}/e").collect())
    assert got == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    tree = "rel string, is_dir boolean, mtime long"
    src = spark.createDataFrame([("d", True, 1), ("d/e", True, 2), ("d/e/f", False, 3), ("same", False, 4)], tree)
    dst = spark.createDataFrame([("d", True, 9), ("d/e", True, 9), ("d/e/f", False, 9), ("same", False, 4)], tree)
    assert [r.rel for r in restore_plan(src, dst).collect()] == ["d/e/f", "d/e", "d"]
