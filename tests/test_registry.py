"""Every registered query with SQL equals DuckDB's result on the smallest scale."""

import duckdb
import pandas as pd
import pytest

from polyview.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_collisions_follow_chains(spark):
    """All of a contested place go to their stems, which may contest the next place; a zip already at its stem stays there."""
    from polyview.operators.maintenance import divert_collisions

    rows = [(k, "author", f"z{k}") for k in range(20)] + [(100, "z3", "z100"), (101, "z100", "z101"), (200, "free", "z200"), (300, None, "z300"), (301, None, "z301")]
    got = {r.zip: r.dest for r in divert_collisions(spark.createDataFrame(rows, "zip long, dest string, stem string")).collect()}
    assert got == {k: f"z{k}" for k in range(20)} | {100: "z100", 101: "z101", 200: "free", 300: None, 301: None}


def test_flat_scope_has_zero_z(spark):
    from polyview.operators.retrieval import robust_z

    rows = spark.createDataFrame([(i, 0, 0.5) for i in range(5)], "row_id long, text_id int, score double")
    assert {r.z for r in robust_z(rows).collect()} == {0.0}


def test_identity_keeps_the_last_nanosecond(spark):
    from pyspark.sql import functions as F

    from polyview.operators.identity import file_identity

    times = [1699999999999999999, 1700000000000000000, 0, -1]
    rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", file_identity(F.lit("a"), F.col("t"), F.lit(5)).alias("id")).collect()
    assert {r.t: r.id for r in rows} == {t: f"a|{t // 10**9}|5" for t in times}


def test_numbering_is_gapless(spark):
    from polyview.functions.order import numbered

    rows = numbered(spark.range(1000).selectExpr("(id * 37) % 1000 as k"), "k").collect()
    assert sorted((r.k, r.nth) for r in rows) == [(k, k) for k in range(1000)]


def test_unknown_pool(spark):
    from polyview.operators.retrieval import pool

    with pytest.raises(ValueError):
        pool(spark.range(1), "median", ["id"])


def test_stl_reader():
    import struct

    from polyview.sources.files import read_stl

    record = struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    assert read_stl(b"x" * 80 + struct.pack("<I", 1) + record).shape == (1, 3, 3)
    assert read_stl(b"x" * 80 + struct.pack("<I", 9) + record * 2).shape == (2, 3, 3)  # a lying header
    assert read_stl(b"solid a\nfacet normal") is None


def test_medians_are_exact(spark):
    import statistics

    import numpy as np

    from polyview.functions.order import medians

    rng = np.random.default_rng(3)
    groups = {"odd": rng.normal(size=301), "even": rng.normal(size=300), "ties": np.repeat(0.25, 500), "one": [7.5], "far": [-1e9, 3.0, 1e9, 1e12], "two": [0.0, 1.0], "near": 1 + rng.normal(size=50) * 1e-9}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("odd", None), ("none", None)]
    got = {r.k: r.mid for r in medians(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()}
    assert got == {k: statistics.median([float(x) for x in v]) for k, v in groups.items()}
    assert medians(spark.createDataFrame([], "k string, x double"), "k", "x").count() == 0
