"""Fill-in-middle against plain slicing by code points, and its bit directory against counting."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

MARKED = "left <P> alone"
ROWS = [(i, t * k) for i, (t, k) in enumerate([("a", 1), ("é日本😀", 7), ("plain words here\n", 400), ("", 1), (MARKED, 1), ("<S", 1), ("<P", 3), ("M>", 2), ("x<M>", 1), ("😀", 5000), ("é", 65), ("a" * 63 + "é", 33)])]
ROWS += [(i, "tie é") for i in range(100, 160)] + [(100, "tie é"), (None, "no id"), (3, None), (-5, "minus five"), (2**62, "é" * 129)]


def brute(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_against_slicing(spark, batch):
    from polyview.llm.fill_middle import fill_in_middle, restore

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'z' AS n", "'z' AS form", "1 AS h1", "'z' AS output", "text AS prefix_chars")
    rows = fill_in_middle(docs).withColumn("back", restore(F.col("form"), F.col("output"))).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert collections.Counter(tuple(r)[:6] for r in rows) == collections.Counter(brute(i, t) for i, t in ROWS)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert collections.Counter((r.doc_id, r.back) for r in rows) == collections.Counter((i, t or "") for i, t in ROWS)
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_rank_and_select():
    from polyview.llm.fill_middle import CodePoints

    rnd = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        text = "".join(rnd.choice(list("aé日😀"), size))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        points, every = CodePoints(data), np.arange(len(data) + 1)
        assert points.rank(every).tolist() == [int((starts < k).sum()) for k in every]
        assert points.select(np.arange(size + 1)).tolist() == [*starts.tolist(), len(data)]
