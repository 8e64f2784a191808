"""Inner products of every magnitude against Python's integers."""

import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    v = {i: [math.floor(256 * y) for y in x] for i, x in rows}
    out = []
    for q in (i for i in v if i % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, **more):
    from polyview.llm.inner_product import top_products

    return sorted(map(tuple, top_products(spark.createDataFrame(rows, SCHEMA), "id % 50 = 0", **more).collect()))


def test_large_components(spark):
    rows = [(0, [1e7, 1e7]), (1, [1.0, 1.0]), (2, [2.0, 0.0])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 1310720000000), (0, 2, 2, 1310720000000)]
    rows = [(0, [1e17, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 1e17]), (3, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("part_rows", [7, 4096])
def test_spread_of_magnitudes(spark, part_rows):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) * 10 ** rnd.uniform(-3, 4.6) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [rnd.choice([-1, 1]) * 2.0**rnd.randrange(10, 23) for _ in range(6)]) for i in range(40)] + [(400 + i, [0.0] * 6) for i in range(20)]
    want = brute(rows)
    assert max(abs(s) for *_, s in want) > 2**53 and run(spark, rows, part_rows=part_rows) == want


def test_scores_past_64_bits(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e17, 1.0]), (1, [1e17, 2.0])])
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e17, 1.0]), (1, [-1e17, 2.0])])
    # a product too far below for 64 bits does no harm where others are better
    rows = [(0, [1e17, 1.0]), (1, [-1e17, 2.0]), *[(k, [0.0, float(k)]) for k in range(2, 9)]]
    assert run(spark, rows) == brute(rows)


def test_no_number_left_out(spark):
    rows = [(0, [1e305, 1.0]), (50, [1.0, 1.0]), (1, [2.0, 2.0])]  # 256e305 is no number of interest
    assert run(spark, rows) == brute(rows[1:])


def test_floors_rise_over_levels(spark, monkeypatch):
    from polyview.llm import inner_product as I

    monkeypatch.setattr(I, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 5)) * rng.uniform(0.01, 3, size=(700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, part_rows=30, k=2, head=2) == brute(rows, 2)
