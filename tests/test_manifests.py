"""JSON files beside a cache, and small readers."""

import json

import numpy as np
import pytest

from polyview.sources import manifests as M


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_run_manifest(spark, tmp_path):
    assert M.read_manifest(spark, str(tmp_path / "none.json")) == {}
    assert M.read_manifest(spark, put(tmp_path / "a.json", {"views": 8, "collection_root": "/lib", "none": None})) == {"views": 8, "collection_root": "/lib", "none": None}
    for bad in ("[1]", "{torn", "null"):
        with pytest.raises(ValueError):
            M.read_manifest(spark, put(tmp_path / "bad.json", bad))


@pytest.mark.parametrize(
    ("asked", "recorded", "more", "want"),
    [
        ("/lib", None, {}, ("/lib", None)),
        ("/lib/a.stl", None, {"is_file": True}, ("/lib", None)),
        ("/lib/", "/lib", {}, ("/lib", None)),
        ("/lib/kit", "/lib", {}, ("/lib", "subdir")),
        ("/other/a.stl", "/lib", {"is_file": True}, ("/lib", None)),
        ("/", "/lib", {"reanchor": True}, ("/", "superdir")),
        ("/library", "/lib", {"read_only": True}, ("/library", "mismatch")),
        ("/", "/lib", {}, None),
        ("/library", "/lib", {}, None),
    ],
)
def test_whose_root(asked, recorded, more, want):
    if want is None:
        with pytest.raises(M.RootMismatch, match=recorded):
            M.anchored_root(asked, recorded, **more)
    else:
        assert M.anchored_root(asked, recorded, **more) == want


def test_labels(spark, tmp_path):
    rows = [("m1", "a/m1.stl", "orig", "+Z"), ("m2", "m2.stl", "holdout", "-X"), ("m3", "m3.stl", "orig", "+Y")]
    path = put(tmp_path / "labels.json", {"collection_root": "/lib", "labels": [dict(zip(("stem", "path", "set", "up"), r)) for r in rows]})
    got = {r.stem: (r.path, r["set"], r.up, r.gold) for r in M.read_labels(spark, path).collect()}
    assert got == {"m1": ("/lib/a/m1.stl", "orig", "+Z", 0), "m2": ("/lib/m2.stl", "holdout", "-X", 5), "m3": ("/lib/m3.stl", "orig", "+Y", 2)}
    assert {r.stem for r in M.read_labels(spark, path, "orig").collect()} == {"m1", "m3"}
    bad = put(tmp_path / "bad.json", {"collection_root": "/", "labels": [{"stem": "x", "path": "x", "set": "s", "up": "up"}]})
    with pytest.raises(Exception, match="no such axis: up"):
        M.read_labels(spark, bad).collect()


def test_arbiter_picks(spark):
    published = [("m1", {"geometry": "+Z", "gemma_sheet256": "+X", "sonnet_sheet512": "-Z", "needs_arbiter": True, "odd_sheet1": 3, "none_sheet2": None}), ("m2", {"gemma_sheet256": "+Y", "ensemble": "-Y"})]
    dumps = [{"gemma@256": {"m1": "-X", "m2": None, "m3": "+Z"}, "a@b@512": {"m1": "+Z"}}]
    got = M.arbiter_picks(spark.createDataFrame([(s, json.dumps(r)) for s, r in published], "stem string, record string"), spark.createDataFrame([(json.dumps(d),) for d in dumps], "json string"))
    want = {("gemma_sheet256", "m1"): 5, ("gemma_sheet256", "m2"): 2, ("gemma_sheet256", "m3"): 0, ("sonnet_sheet512", "m1"): 1, ("a@b_sheet512", "m1"): 0}
    assert {(r.config, r.stem): r.pick for r in got.collect()} == want


def test_newest_walk(spark, tmp_path):
    for name, walk in (("c1/walk-a", {"scanned": 5.5, "files": ["old"]}), ("c2/walk-b", {"scanned": 7, "files": ["x", "y"]}), ("c2/walk-c", {"files": ["unscanned"]}), ("c3/other", {"scanned": 99, "files": ["no walk"]})):
        put(tmp_path / f"{name}.json", walk)
    assert sorted(r.path for r in M.newest_walk(spark, f"{tmp_path}/c*/walk-*.json").collect()) == ["x", "y"]
    with pytest.raises(FileNotFoundError):
        M.newest_walk(spark, f"{tmp_path}/none*/walk-*.json")


def test_stored_embeddings(spark):
    files = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k3"), ("d", "k1")], "file string, embed_key string")
    store = spark.createDataFrame([("k1", 0, [1.0]), ("k1", 1, [2.0]), ("k9", 0, [3.0])], "embed_key string, view int, embedding array<double>")
    rows, missing = M.stored_embeddings(files, store)
    assert sorted((r.file, r.view) for r in rows.collect()) == [("a", 0), ("a", 1), ("d", 0), ("d", 1)] and missing == 2
    with pytest.raises(LookupError):
        M.stored_embeddings(files.filter("file = 'b'"), store)


def test_pose_files(spark):
    """Versions are numbers; a file that is no object is an error that names it."""
    from polyview.operators.caches import pose_entries

    good = {"a": {"v": 4, "source": "heuristic"}, "b": {"v": 4.0, "source": "vlm"}, "c": {"v": "4"}, "d": {"v": 3}, "e": {"v": True}, "f": [4], "g": None, "h": {"source": "x"}, "i": '{"v": 4}', "j": {"v": 4}}
    files = spark.createDataFrame([("good", json.dumps(good)), ("none", None), ("empty", "{}")], "file string, json string")
    assert {(r.file, r.key, r.source) for r in pose_entries(files).collect()} == {("good", "a", "geometry"), ("good", "b", "vlm"), ("good", "j", None)}
    for bad in ("[1]", "{torn", "null", '"{}"'):
        one = spark.createDataFrame([("here.json", bad)], "file string, json string")
        with pytest.raises(Exception, match="here.json"):
            pose_entries(one).collect()
        assert pose_entries(one, strict=False).collect() == []


def test_numbers_within_hot_groups(spark):
    from polyview.functions.order import numbered_within

    rows = [("hot", k, k * 7 % 1000) for k in range(1000)] + [(None, k, k) for k in range(50)] + [(f"g{k % 9}", k, k % 5) for k in range(90)]
    got = numbered_within(spark.createDataFrame(rows, "g string, id int, o int").repartition(5), "g", ["o", "id"]).collect()
    by = {}
    for g, i, o in rows:
        by.setdefault(g, []).append((o, i))
    want = {(g, i): n for g, members in by.items() for n, (o, i) in enumerate(sorted(members))}
    assert {(r.g, r.id): r.nth for r in got} == want and len(got) == len(rows) and got[0].__fields__ == ["g", "id", "o", "nth"]


def test_clusters_against_plain_distances(spark):
    """Sizes fall, members are in order of distance, everyone is at the nearest centre, and no single seed is cheaper."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    from polyview.operators.cluster import clusters

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6)) * 3
    views = [(i, v, (centres[i % 4 if i % 5 else 0] + rng.normal(size=6) * 0.3).tolist()) for i in range(80) for v in range(3)]
    df = spark.createDataFrame(views, "row_id long, view int, embedding array<double>")
    got = clusters(df, 4).collect()
    mean = {i: np.mean([e for r, _, e in views if r == i], axis=0) for i in range(80)}
    unit = {i: m / np.linalg.norm(m) for i, m in mean.items()}
    by = {}
    for r in got:
        by.setdefault(r.cluster, []).append(r)
    assert sorted(r.row_id for r in got) == list(range(80)) and [len(by[c]) for c in sorted(by)] == sorted(map(len, by.values()), reverse=True)
    centre = {c: np.mean([unit[r.row_id] for r in members], axis=0) for c, members in by.items()}
    for c, members in by.items():
        placed = sorted(members, key=lambda r: r.place)
        assert [r.place for r in placed] == list(range(1, len(placed) + 1)) and [r.distance for r in placed] == sorted(r.distance for r in placed)
        for r in members:
            distances = {k: np.linalg.norm(unit[r.row_id] - v) for k, v in centre.items()}
            assert min(distances, key=distances.get) == c and abs(distances[c] - r.distance) < 1e-3 and r.size == len(members)
    cost = sum(np.linalg.norm(unit[r.row_id] - centre[r.cluster]) ** 2 for r in got)
    data = spark.createDataFrame([(Vectors.dense(u),) for u in unit.values()], ["features"])
    assert cost <= min(KMeans(k=4, seed=s, maxIter=20).fit(data).summary.trainingCost for s in (0, 5, 9)) + 1e-6


def test_small_readers(spark, tmp_path):
    from polyview.sources.files import ListingSource, categories, scan_npy

    for name in ("a", "b"):
        np.save(tmp_path / f"{name}.npy", np.arange(6, dtype=np.float16).reshape(2, 3) + ord(name))
    (tmp_path / "torn.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-3])
    (tmp_path / "junk.npy").write_bytes(b"no array")
    got = {(r.stem, r.view): r.embedding for r in scan_npy(spark, str(tmp_path)).collect()}
    assert got == {(n, v): [ord(n) + 3 * v + k for k in range(3)] for n in "ab" for v in (0, 1)}
    text = put(tmp_path / "categories.txt", "  dragon \n\n\t\r\nbarrel\r\nlast one")
    assert [r.category for r in categories(spark, text).orderBy("line").collect()] == ["dragon", "barrel", "last one"]
    (tmp_path / "tree" / "_hidden" / "x").mkdir(parents=True)
    for rel in ("top.stl", "_hidden/x/_f.stl", "_hidden/empty"):
        (tmp_path / "tree" / rel).write_bytes(b"" if rel.endswith("empty") else b"abc")
    spark.dataSource.register(ListingSource)
    rows = spark.read.format("listing").option("path", str(tmp_path / "tree")).load().collect()
    assert sorted((r.rel, r.size) for r in rows) == [("_hidden/empty", 0), ("_hidden/x/_f.stl", 3), ("top.stl", 3)] and all(r.mtime_ns > 1e18 for r in rows)


def test_snapshots_by_number(spark, tmp_path):
    """A writer whose clock lags still writes the newest version."""
    import os

    from polyview.sources.sinks import read_snapshot, write_snapshot

    base = str(tmp_path / "s")
    for n in (3, 5, 2):
        write_snapshot(spark.range(n), f"file://{base}")
        for p in (tmp_path / "s" / "commits").iterdir():
            os.utime(p, (10**9 - n, 10**9 - n))
    assert read_snapshot(spark, f"file://{base}").count() == 2
