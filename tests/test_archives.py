"""Archives read by ranges, and plans carried out, interrupted, and carried out again."""

import io
import os
import random
import zipfile
import zlib

import pytest

from polyview.sources import apply as A
from polyview.sources.archives import content_elsewhere, crc_joined, file_checksums, member_faults, scan_archives


def make(path, members, method=zipfile.ZIP_DEFLATED):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return path


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in sorted(path.rglob("*")) if p.is_file() and A.JOURNALS not in p.parts}


def test_directories_without_reading_archives(spark, tmp_path):
    make(tmp_path / "d" / "a.ZIP", {"a/": b"", "a/x.stl": b"x" * 1000, "a/é.txt": b"y"})
    make(tmp_path / "empty.zip", {})
    torn = make(tmp_path / "torn.zip", {"m": os.urandom(5000)})
    torn.write_bytes(torn.read_bytes()[:-30])
    (tmp_path / "none.zip").write_bytes(b"")
    with open(tmp_path / "huge.zip", "wb") as f:
        f.truncate(5 << 30)  # a hole: the archive behind it needs 64-bit offsets
    with zipfile.ZipFile(tmp_path / "huge.zip", "a") as z:
        z.writestr("far/away.stl", b"z" * 77)
    assert os.stat(tmp_path / "huge.zip").st_blocks * 512 < 1 << 20
    rows = scan_archives(spark, str(tmp_path)).collect()
    got = {(r.zip.rsplit("/", 1)[-1], r.name): (r.place, r.size, r.crc, r.is_dir) for r in rows if not r.error}
    assert got == {("a.ZIP", "a/"): (0, 0, 0, True), ("a.ZIP", "a/x.stl"): (1, 1000, zlib.crc32(b"x" * 1000), False), ("a.ZIP", "a/é.txt"): (2, 1, zlib.crc32(b"y"), False), ("huge.zip", "far/away.stl"): (0, 77, zlib.crc32(b"z" * 77), False)}
    assert {r.zip.rsplit("/", 1)[-1] for r in rows if r.error} == {"torn.zip", "none.zip"}


def test_members_are_read_through(spark, tmp_path):
    good = make(tmp_path / "g.zip", {"a": b"a" * 3_000_000, "b": b"b"})
    bad = make(tmp_path / "b.zip", {"a": os.urandom(5000), "b": b"fine"}, zipfile.ZIP_STORED)
    data = bytearray(bad.read_bytes())
    data[100] ^= 1
    bad.write_bytes(data)
    asked = spark.createDataFrame([(str(good), "a"), (str(good), "b"), (str(good), "no"), (str(bad), "a"), (str(bad), "b"), (str(tmp_path / "gone.zip"), "a")], "zip string, name string")
    got = {(r.zip.rsplit("/", 1)[-1], r.name): r.fault is None for r in member_faults(asked).collect()}
    assert got == {("g.zip", "a"): True, ("g.zip", "b"): True, ("g.zip", "no"): False, ("b.zip", "a"): False, ("b.zip", "b"): True, ("gone.zip", "a"): False}


@pytest.mark.parametrize("width", [7, 1000, 1 << 25])
def test_checksums_by_ranges(spark, tmp_path, width):
    rnd = random.Random(1)
    files = []
    for k, n in enumerate([0, 1, 6, 7, 8, 999, 2500]):
        data = rnd.randbytes(n)
        (tmp_path / f"f{k}").write_bytes(data)
        files.append((str(tmp_path / f"f{k}"), n, zlib.crc32(data)))
    files.append((str(tmp_path / "gone"), 50, None))
    (tmp_path / "short").write_bytes(b"abc")
    files.append((str(tmp_path / "short"), 9, None))
    got = file_checksums(spark.createDataFrame([f[:2] for f in files], "path string, size long"), width)
    assert sorted(map(tuple, got.collect())) == sorted(files)


def test_joined_checksums():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(40)), rnd.randbytes(rnd.randrange(4000))
        assert crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_content_elsewhere_by_real_files(spark, tmp_path):
    """Unpacked by hand into another layout; same name and size but other bytes; renders missing; a swap's copy does not count."""
    models = {f"m{k}.stl": bytes([k]) * 500 for k in range(7)}
    make(tmp_path / "p" / "same.zip", {f"kit/{n}": d for n, d in models.items()} | {"kit/pic.png": b"gone"})
    make(tmp_path / "q" / "other.zip", {f"kit/{n}": d for n, d in models.items()})
    make(tmp_path / "top.zip", {"deep/m3.stl": models["m3.stl"]})
    make(tmp_path / "r" / "swap.zip", {"only.stl": b"o" * 9})
    for n, d in models.items():
        (tmp_path / "p" / "by hand").mkdir(exist_ok=True)
        (tmp_path / "p" / "by hand" / n).write_bytes(d)
        (tmp_path / "q" / "x").mkdir(exist_ok=True)
        (tmp_path / "q" / "x" / n).write_bytes(d if n != "m2.stl" else b"?" * 500)
    (tmp_path / "r" / "kit.replaced").mkdir()
    (tmp_path / "r" / "kit.replaced" / "only.stl").write_bytes(b"o" * 9)
    got = {r.zip: r.elsewhere for r in content_elsewhere(spark, str(tmp_path)).collect()}
    assert got == {"./p/same.zip": True, "./q/other.zip": False, "./top.zip": True, "./r/swap.zip": False}


PLAN = "zip string, dest string, replace boolean"


def test_unpacking_and_a_second_run(spark, tmp_path):
    own = make(tmp_path / "own.zip", {"own/": b"", "own/a.stl": b"a", "own/s/b.stl": b"b"})
    pile = make(tmp_path / "pile.zip", {"a.stl": b"1", "x/b.stl": b"2"})
    one = make(tmp_path / "one.zip", {"only.stl": b"3"})
    evil = make(tmp_path / "evil.zip", {"../out.stl": b"!"})
    bad = make(tmp_path / "bad.zip", {"z.stl": os.urandom(3000)}, zipfile.ZIP_STORED)
    bad.write_bytes(bad.read_bytes().replace(bad.read_bytes()[60:64], b"\0\1\2\3", 1))
    c1, c2 = make(tmp_path / "c1.zip", {"c/a": b"1"}), make(tmp_path / "c2.zip", {"c/a": b"2"})
    for kept in ("kept", "pile"):
        (tmp_path / kept).mkdir()
    (tmp_path / "kept" / "mine").write_bytes(b"mine")
    rows = [(str(own), str(tmp_path / "own"), False), (str(pile), str(tmp_path / "pile"), False), (str(one), str(tmp_path / "one"), None), (str(evil), str(tmp_path / "evil"), False), (str(bad), str(tmp_path / "bad"), False)]
    rows += [(str(c1), str(tmp_path / "c"), True), (str(c2), str(tmp_path / "c"), True), (str(one), str(tmp_path / "kept"), False), (str(tmp_path / "no.zip"), str(tmp_path / "no"), False)]
    plan = spark.createDataFrame(rows, PLAN)
    got = {(r.zip.rsplit("/", 1)[-1], r.dest.rsplit("/", 1)[-1]): r.outcome.split(":")[0] for r in A.unpack(plan, str(tmp_path)).collect()}
    assert got == {("own.zip", "own"): "unpacked", ("pile.zip", "pile"): "unpacked", ("one.zip", "one"): "unpacked", ("evil.zip", "evil"): "failed", ("bad.zip", "bad"): "failed", ("c1.zip", "c"): "refused", ("c2.zip", "c"): "refused", ("one.zip", "kept"): "failed", ("no.zip", "no"): "failed"}
    want = tree(tmp_path)
    assert {k: v for k, v in want.items() if not k.endswith(".zip")} == {"own/a.stl": b"a", "own/s/b.stl": b"b", "pile/a.stl": b"1", "pile/x/b.stl": b"2", "one/only.stl": b"3", "kept/mine": b"mine"}
    again = {r.outcome.split(":")[0] for r in A.unpack(plan, str(tmp_path)).collect()}
    assert again == {"failed", "refused"} and tree(tmp_path) == want
    repair = spark.createDataFrame([(str(one), str(tmp_path / "kept"), True)], PLAN)
    assert [r.outcome for r in A.unpack(repair, str(tmp_path)).collect()] == ["unpacked"] and tree(tmp_path / "kept") == {"only.stl": b"3"}
    assert not [p for p in tmp_path.rglob("*") if p.name.endswith((".partial", ".replaced"))]


class Lost(Exception):
    pass


def interrupted(monkeypatch, call, name, nth):
    """Run ``call``, which dies at the nth call of os.``name`` or shutil.``name``."""
    module = A.os if hasattr(os, name) else A.shutil
    real, count = getattr(module, name), [0]

    def dying(*a, **k):
        count[0] += 1
        if count[0] == nth:
            raise Lost
        return real(*a, **k)

    with monkeypatch.context() as m:
        m.setattr(module, name, dying)
        with pytest.raises(Lost):
            call()


@pytest.mark.parametrize(("name", "nth"), [("rename", 1), ("rename", 2), ("rmtree", 1), ("rmtree", 2)])
def test_a_swap_that_dies_anywhere(tmp_path, monkeypatch, name, nth):
    dest, staged, aside = (str(tmp_path / n) for n in ("d", "d.m.partial", "d.replaced"))
    for folder, text in ((dest, "old"), (staged, "new")):
        os.makedirs(folder)
        with open(f"{folder}/f", "w") as f:
            f.write(text)
    interrupted(monkeypatch, lambda: A.swap(dest, staged, aside, True), name, nth)
    whole = [open(f"{p}/f").read() for p in (dest, aside) if os.path.exists(f"{p}/f")]
    assert whole and set(whole) <= {"old", "new"}
    assert A.swap(dest, staged, aside, True) == "unpacked" and A.swap(dest, staged, aside, True) == "unpacked"
    assert os.listdir(tmp_path) == ["d"] and open(f"{dest}/f").read() == "new"


def run_folder(tmp_path, spark, committed):
    """A run that staged one of two archives and then died, before or after its commit."""
    folder = tmp_path / A.JOURNALS / "run1"
    stager = A._Stager(str(folder))
    zips = [make(tmp_path / f"z{k}.zip", {f"z{k}/f": b"new"}) for k in range(2)]
    (tmp_path / "z1").mkdir()
    (tmp_path / "z1" / "f").write_bytes(b"old")
    message = stager.write({"zip": str(z), "dest": str(tmp_path / z.stem), "replace": True} for z in zips)
    stager.write(iter([{"zip": str(zips[0]), "dest": str(tmp_path / "z0"), "replace": True}]))  # the same task, run twice
    if committed:
        stager.commit([message, None])
    return stager


def test_a_lost_driver_before_the_commit(spark, tmp_path):
    run_folder(tmp_path, spark, False)
    assert (tmp_path / "z1" / "f").read_bytes() == b"old" and not (tmp_path / "z0").exists()
    assert A.recover(spark, str(tmp_path)) == ["run1: undone"] and A.recover(spark, str(tmp_path)) == []
    assert sorted(p.name for p in tmp_path.iterdir() if p.name != A.JOURNALS) == ["z0.zip", "z1", "z1.zip"] and (tmp_path / "z1" / "f").read_bytes() == b"old"


def test_a_lost_driver_after_the_commit(spark, tmp_path):
    run_folder(tmp_path, spark, True)
    staged = next(tmp_path.glob("z1.*.partial"))
    os.rename(tmp_path / "z1", tmp_path / "z1.replaced")  # died between the two renames
    assert staged.exists() and A.recover(spark, str(tmp_path)) == ["run1: finished"]
    assert sorted(p.name for p in tmp_path.iterdir() if p.name != A.JOURNALS) == ["z0", "z0.zip", "z1", "z1.zip"]
    assert (tmp_path / "z1" / "f").read_bytes() == (tmp_path / "z0" / "f").read_bytes() == b"new"
    assert A.recover(spark, str(tmp_path)) == []


def test_an_aborted_write(spark, tmp_path):
    run_folder(tmp_path, spark, False).abort([None])
    assert sorted(p.name for p in tmp_path.iterdir() if p.name != A.JOURNALS) == ["z0.zip", "z1", "z1.zip"]


def test_moves(spark, tmp_path):
    """Renamed, already renamed, both there, neither, and two files for one name."""
    for n in ("a.npy", "b2.npy", "c.npy", "c2.npy", "e.npy", "f.npy"):
        (tmp_path / n).write_bytes(n.encode())
    plan = [("a", "sub/a2"), ("b", "b2"), ("c", "c2"), ("d", "d2"), ("e", "x"), ("f", "x"), ("a", "sub/a2"), ("g", "g")]
    df = spark.createDataFrame([(f"{tmp_path}/{s}.npy", f"{tmp_path}/{d}.npy") for s, d in plan], "src string, dst string")
    want = {"moved": 1, "already": 1, "superseded": 1, "missing": 1, "contested": 2}
    assert A.move_files(df) == want and A.move_files(df) == want | {"moved": 0, "already": 2}
    assert tree(tmp_path) == {"sub/a2.npy": b"a.npy", "b2.npy": b"b2.npy", "c.npy": b"c.npy", "c2.npy": b"c2.npy", "e.npy": b"e.npy", "f.npy": b"f.npy"}


def test_times(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f").write_bytes(b"x")
    want = {"d": 1_600_000_000_123_456_789, "d/e": 1_500_000_000_000_000_001, "d/e/f": 1_400_000_000_999_999_999}
    plan = spark.createDataFrame([(r, r != "d/e/f", t) for r, t in want.items()] + [("gone", False, 5)], "rel string, is_dir boolean, mtime_ns long")
    for _ in range(2):
        assert [r.rel for r in A.restore_times(plan, str(tmp_path)).collect()] == ["gone"]
        assert {r: os.stat(tmp_path / r).st_mtime_ns for r in want} == want
