"""Plans of real folders, and the commands that carry them out."""

import os
import shutil
import zipfile

import pytest

from polyview.__main__ import main
from polyview.sources.trees import TreesDiffer, scan_tree, times_plan, unpack_plan


def make(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


@pytest.fixture()
def root(tmp_path):
    r = tmp_path / "lib"
    make(r / "a" / "Barrier_NoSupports.zip", {"Barrier_NoSupports/": "", "Barrier_NoSupports/b.stl": "b" * 9})
    make(r / "a" / "Barrier_Supported.zip", {"Barrier_Supported/b.stl": "s"})
    make(r / "a" / "pile.zip", {"x.stl": "x", "y/z.stl": "zz"})
    make(r / "done.zip", {"done/d.stl": "d"})
    make(r / "worn.zip", {"worn/w.stl": "w" * 5, "worn/pic.png": "p"})
    for k in (1, 2):
        make(r / "c" / f"model{k}.zip", {"author/m.stl": f"model {k}"})
    make(r / "e" / "curated.zip", {"curated/k.stl": "k" * 50})
    make(r / "evil.zip", {"../out.stl": "!"})
    make(r / "empty.zip", {})
    (r / "torn.zip").write_bytes(b"PK torn")
    for rel, data in {"done/d.stl": "d", "worn/w.stl": "w", "e/by hand/k.stl": "k" * 50}.items():
        (r / rel).parent.mkdir(parents=True, exist_ok=True)
        (r / rel).write_text(data)
    return r


def actions(plan, root):
    return {r.zip[len(str(root)) + 1 :]: (r.action, None if r.dest is None else r.dest[len(str(root)) + 1 :], r.replace) for r in plan.collect()}


WANT = {
    "a/Barrier_NoSupports.zip": ("extract", "a/Barrier_NoSupports", False), "a/Barrier_Supported.zip": ("skip-tagged", "a/Barrier_Supported", False), "a/pile.zip": ("extract", "a/pile", False),
    "done.zip": ("done", "done", False), "worn.zip": ("repair-held", "worn", False), "c/model1.zip": ("extract", "c/model1", False), "c/model2.zip": ("extract", "c/model2", False),
    "e/curated.zip": ("elsewhere", "e/curated", False), "evil.zip": ("unsafe", "evil", False), "empty.zip": ("extract", "empty", False), "torn.zip": ("unreadable", None, False),
}


def test_plan(spark, root):
    got = actions(unpack_plan(spark, str(root)), root)
    evil = got.pop("evil.zip")
    assert evil[0] == "unsafe" and got == {k: v for k, v in WANT.items() if k != "evil.zip"}
    more = actions(unpack_plan(spark, str(root) + "/", every_variant=True, repair=[str(root / "worn.zip")], check_elsewhere=False), root)
    assert more["a/Barrier_Supported.zip"][0] == "extract" and more["worn.zip"] == ("repair", "worn", True) and more["e/curated.zip"][0] == "extract"
    assert actions(unpack_plan(spark, str(root), repair=[str(root)]), root)["worn.zip"][0] == "repair"
    assert actions(unpack_plan(spark, str(root), repair=[str(root / "c")]), root)["worn.zip"][0] == "repair-held"


def test_commands(spark, root, capsys):
    before = sorted(str(p) for p in root.rglob("*"))
    assert main(["unpack", str(root)]) == 0 and sorted(str(p) for p in root.rglob("*")) == before
    assert "extract             5" in capsys.readouterr().out
    assert main(["unpack", str(root), "--apply", "--repair", str(root / "worn.zip")]) == 0
    out = capsys.readouterr().out
    assert "unpacked            6" in out
    texts = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*.stl")}
    assert texts == {"a/Barrier_NoSupports/b.stl": "b" * 9, "a/pile/x.stl": "x", "a/pile/y/z.stl": "zz", "done/d.stl": "d", "worn/w.stl": "w" * 5, "c/model1/m.stl": "model 1", "c/model2/m.stl": "model 2", "e/by hand/k.stl": "k" * 50}
    assert main(["unpack", str(root)]) == 0  # all that could be done is done
    again = capsys.readouterr().out
    assert "done                6" in again and "repair" not in again


def test_times(spark, tmp_path, capsys):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "d" / "e" / "f").mkdir(parents=True)
    (a / "lost+found").mkdir()
    for rel in ("top.stl", "d/one", "d/e/f/deep"):
        (a / rel).write_text(rel)
    shutil.copytree(a, b)
    shutil.rmtree(b / "lost+found")
    for k, p in enumerate(sorted(a.rglob("*"), reverse=True)):
        os.utime(p, ns=(10**18 + k, 10**18 + 7 * k))
    assert sorted(r.rel for r in scan_tree(spark, str(b)).collect()) == ["d", "d/e", "d/e/f", "d/e/f/deep", "d/one", "top.stl"]
    assert main(["times", str(a), str(b)]) == 0 and "3 files and 3 folders" in capsys.readouterr().out
    assert main(["times", str(a), str(b), "--apply"]) == 0
    assert {p.relative_to(b): p.stat().st_mtime_ns for p in b.rglob("*")} == {p.relative_to(a): p.stat().st_mtime_ns for p in a.rglob("*") if p.name != "lost+found"}
    capsys.readouterr()
    assert main(["times", str(a), str(b), "--apply"]) == 0 and "0 files and 0 folders" in capsys.readouterr().out
    (b / "d" / "one").write_text("other size")
    (b / "extra").write_text("")
    with pytest.raises(TreesDiffer, match="1 extra, 1 size"):
        times_plan(spark, str(a), str(b))
    assert main(["times", str(a), str(b), "--apply"]) == 1


def test_classify_and_cluster(spark, tmp_path):
    views = spark.createDataFrame([(i, v, [float(i % 3 == a) + 0.01 * v for a in range(3)]) for i in range(9) for v in range(2)], "row_id long, view int, embedding array<double>")
    texts = spark.createDataFrame([(t, [float(t == a) for a in range(3)]) for t in range(3)], "text_id int, embedding array<double>")
    views.write.parquet(str(tmp_path / "views"))
    texts.write.parquet(str(tmp_path / "texts"))
    assert main(["classify", str(tmp_path / "views"), str(tmp_path / "texts"), str(tmp_path / "results")]) == 0
    rows = {r["file"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "results")).collect()}
    assert {int(f): int(r["top1"]) for f, r in rows.items()} == {i: i % 3 for i in range(9)} and all(float(r["score1"]) > 0.9 > float(r["score3"]) for r in rows.values())
    assert main(["cluster", str(tmp_path / "views"), str(tmp_path / "clusters"), "-k", "3"]) == 0
    by = {}
    for r in spark.read.option("header", True).csv(str(tmp_path / "clusters")).collect():
        by.setdefault(r["cluster"], set()).add(int(r["file"]) % 3)
    assert sorted(map(len, by.values())) == [1, 1, 1]
