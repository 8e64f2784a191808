"""Meshes in both forms, cut anywhere, torn anywhere; normals, boxes and drawn points."""

import math
import struct

import numpy as np
import pytest

from polyview.operators.surface import extents, sample_points, with_normals
from polyview.sources.meshes import CORNERS, parse_texts, read_meshes


def triangles(n, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, 3, 3)).astype(np.float32) * 50
    if n > 3:
        v[1, 1:] = v[1, 0]  # a point
        v[2, 2] = (v[2, 0] + v[2, 1]) / 2  # a line, up to rounding
    return v


def binary(v, declared=None, head=b"binary"):
    body = b"".join(struct.pack("<3f", 0, 0, 0) + t.astype("<f4").tobytes() + b"\0\0" for t in v)
    return head.ljust(80, b" ") + struct.pack("<I", len(v) if declared is None else declared) + body


def text(v, name="part facet of a solid", end="\n"):
    rows = [f"solid {name}"]
    for t in v:
        rows += ["  facet normal 0 0 0", "    outer loop", *[f"      vertex {' '.join(np.format_float_scientific(x) for x in p)}" for p in t], "    endloop", "  endfacet"]
    return (end.join([*rows, f"endsolid {name}"]) + end).encode()


def folder(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / "m" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / ("deep" if len(name) % 2 else "") / f"{name}.{'STL' if len(name) % 3 else 'stl'}").write_bytes(data)
    return str(tmp_path / "m")


def rows(facets):
    out = {}
    for r in facets.orderBy("path", "at").collect():
        out.setdefault(r.path.rsplit("/", 1)[-1][:-4], []).append([r[c] for c in CORNERS])
    return out


@pytest.mark.parametrize("width", [97, 1000, 1 << 25])
def test_both_forms_give_the_same_facets(spark, tmp_path, width):
    v = triangles(60)
    path = folder(tmp_path, b=binary(v), a=text(v), crlf=text(v, end="\r\n"), lies=binary(v, declared=7), two=text(v[:30]) + text(v[30:], "other"), cut=binary(v)[:-100])
    facets, refused = read_meshes(spark, path, width)
    got, want = rows(facets), v.astype(np.float64).reshape(-1, 9).tolist()
    assert refused.collect() == [] and got == {n: want for n in ("b", "a", "crlf", "lies", "two")} | {"cut": want[:-2]}  # two records short: the file wins


@pytest.mark.parametrize("width", [211, 1 << 25])
def test_torn_files_are_refused_whole(spark, tmp_path, width):
    v = triangles(40)
    nan, huge = v.copy(), v.copy()
    nan[33, 2, 1], huge[33, 0, 0] = np.nan, 2e9
    bad = {
        "no_end": text(v)[: -len("endsolid part facet of a solid\n")], "mid": text(v)[:2000], "hole": text(v).replace(b"endloop", b"endlop", 20).replace(b"endlop", b"endloop", 19),
        "nan_text": text(nan), "huge_text": text(huge), "nan_counted": binary(nan, declared=3), "huge_counted": binary(huge, declared=3), "odd": binary(v)[:-7], "empty": b"", "short": b"solid",
        "nothing": text(v[:0]), "none": binary(v[:0]), "junk": b"\x7f" * 5000, "letters": b"hello " * 400, "number": text(v).replace(b"vertex ", b"vertex x", 1), "tail": text(v) + b"garbage",
    }
    facets, refused = read_meshes(spark, folder(tmp_path, good=text(v), honest=binary(nan), **bad), width)
    assert {r.path.rsplit("/", 1)[-1][:-4] for r in refused.collect()} == set(bad)
    got = rows(facets)
    assert set(got) == {"good", "honest"} and len(got["good"]) == 40 and math.isnan(got["honest"][33][7])  # an honest header is believed


def test_a_text_whose_length_fits_records_is_no_binary(spark, tmp_path):
    v = triangles(5)
    data = text(v, "x")
    data = data.replace(b"solid x", b"solid x" + b" " * (-(len(data) - 84) % 50), 1)
    assert (len(data) - 84) % 50 == 0
    facets, refused = read_meshes(spark, folder(tmp_path, t=data))
    assert rows(facets) == {"t": v.astype(np.float64).reshape(-1, 9).tolist()} and refused.count() == 0


def test_normals_and_boxes(spark, tmp_path):
    v = triangles(50, 3)
    facets, _ = read_meshes(spark, folder(tmp_path, n=binary(v)))
    w = v.astype(np.float64)
    cross = np.cross(w[:, 1] - w[:, 0], w[:, 2] - w[:, 0])
    norm = np.linalg.norm(cross, axis=1)
    for r, c, n in zip(with_normals(facets).orderBy("at").collect(), cross, norm):
        want = c / n if n > 0 else np.zeros(3)
        assert np.allclose([r.nx, r.ny, r.nz], want, atol=1e-9) and math.isclose(r.area, n / 2, abs_tol=1e-12)
    box = extents(facets).first()
    assert box.n_facets == 50 and math.isclose(box.area, norm.sum() / 2) and (box.x_low, box.z_high) == (w[..., 0].min(), w[..., 2].max())


def test_points_follow_area(spark, tmp_path, monkeypatch):
    from polyview.operators import surface as S

    v = triangles(200, 5) * np.random.default_rng(1).uniform(0.1, 3, size=(200, 1, 1)).astype(np.float32)
    v[7] = 0
    path = folder(tmp_path, big=text(v), flat=binary(np.zeros((4, 3, 3), np.float32)), one=binary(v[:1]))
    n = 20000
    results = []
    for block, width in ((1 << 20, 1 << 25), (3000, 999)):
        monkeypatch.setattr(S, "BLOCK", block)
        facets, _ = read_meshes(spark, path, width)
        got = sample_points(facets, n, seed=4).toPandas().sort_values(["path", "point"], ignore_index=True)
        results.append(got)
    one, two = results
    assert one["path"].str[-7:].value_counts().to_dict() == {"big.stl": n, "one.stl": n} and (one["point"] == two["point"]).all()
    # sums in blocks round otherwise than one long sum: a draw on a border may go to the next facet
    assert (np.abs(one[list("xyz")] - two[list("xyz")]).max(axis=1) > 1e-6).sum() <= 2
    w = v.astype(np.float64)
    cross = np.cross(w[:, 1] - w[:, 0], w[:, 2] - w[:, 0])
    area = np.linalg.norm(cross, axis=1) / 2
    share = area / area.sum()
    p = one[one["path"].str.endswith("big.stl")]
    normals = cross / np.where(area > 0, 2 * area, 1)[:, None]
    facet = np.array([np.argmin(np.abs(normals - q).sum(axis=1)) for q in p[["nx", "ny", "nz"]].to_numpy()])
    hits = np.bincount(facet, minlength=200) / n
    assert (np.abs(hits - share) <= 5 * np.sqrt(share * (1 - share) / n) + 1e-9).all() and hits[7] == 0
    off = np.abs(((p[list("xyz")].to_numpy() - w[facet, 0]) * normals[facet]).sum(axis=1))
    assert off.max() < 1e-6  # every point lies on its facet's plane
    assert not one.equals(sample_points(read_meshes(spark, path)[0], n, seed=5).toPandas())


def test_a_cube_stands_on_its_base(spark, tmp_path):
    """The evidence for an upright pose from drawn points: a slab with a wide flat base below a spike."""
    from pyspark.sql import functions as F

    from polyview.operators.pose import geometry_evidence

    base = [[[0, 0, 0], [0, 9, 0], [9, 0, 0]], [[9, 9, 0], [9, 0, 0], [0, 9, 0]]]  # facing down
    spike = [[[0, 0, 0], [9, 0, 0], [4.5, 4.5, 40]], [[9, 0, 0], [9, 9, 0], [4.5, 4.5, 40]], [[9, 9, 0], [0, 9, 0], [4.5, 4.5, 40]], [[0, 9, 0], [0, 0, 0], [4.5, 4.5, 40]]]
    facets, _ = read_meshes(spark, folder(tmp_path, s=binary(np.array(base + spike, np.float32))))
    points = sample_points(facets, 4000).withColumn("model", F.col("path"))
    geo = {r.candidate: r.geo for r in geometry_evidence(points, 0.02, -0.9).collect()}
    best = max(geo, key=geo.get)
    assert geo[best] == pytest.approx(81 / (81 + 4 * 4.5 * math.hypot(4.5, 40)), abs=0.03) and sorted(geo.values())[-2] < geo[best] / 2


def test_texts_in_a_column(spark):
    v = triangles(9)
    df = spark.createDataFrame([(1, text(v).decode()), (2, None), (3, "solid x"), (4, text(v).decode()[:-30])], "id long, body string")
    got = parse_texts(df, "id", "body").orderBy("at").collect()
    assert [r.id for r in got] == [1] * 9 and [[r[c] for c in CORNERS] for r in got] == v.astype(np.float64).reshape(-1, 9).tolist()
