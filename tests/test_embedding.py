"""A counting stub in place of a model."""

import os

import numpy as np
import pytest

from polyview.operators.embedding import embed_rows


def stub(folder):
    """A model that writes down when it is loaded and what sizes of batches it sees."""

    def load():
        (folder / f"load-{os.getpid()}-{os.urandom(4).hex()}").touch()
        return np.arange(1.0, 4.0)

    def prepare(data):
        if data == b"torn":
            raise OSError("cannot identify image")
        return int(data)

    def embed(model, inputs):
        (folder / f"batch-{len(inputs)}-{os.urandom(6).hex()}").touch()
        if 13 in inputs:
            raise RuntimeError("out of memory")
        return np.array([model * x if x != 14 else model * np.nan for x in inputs])

    return load, prepare, embed


def sizes(folder, kind):
    return sorted((int(p.split("-")[1]) for p in os.listdir(folder) if p.startswith(kind)), reverse=True)


def test_full_batches_one_model_and_bad_images(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    values = [str(k).encode() for k in range(100)]
    values[40], values[50], values[60] = b"torn", None, b"0"
    rows = spark.createDataFrame([(k, v, f"n{k}", "x") for k, v in enumerate(values)], "id int, image binary, name string, error string").coalesce(1)
    load, prepare, embed = stub(tmp_path)
    out = embed_rows(rows, "image", f"stub {tmp_path}", load, prepare, embed, batch=16).collect()
    again = embed_rows(rows.limit(3), "image", f"stub {tmp_path}", load, prepare, embed, batch=16).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.id for r in out] == list(range(100)) and out[0].asDict().keys() == {"id", "name", "embedding", "error"} and [r.id for r in again] == [0, 1, 2]
    unit = (np.arange(1.0, 4.0) / np.sqrt(14)).tolist()
    for r in out:
        if r.id in (0, 60):
            assert r.embedding == [0, 0, 0] and r.error is None
        elif r.id in (13, 14, 40, 50):
            assert r.embedding is None and r.error.split(":")[0] == {13: "RuntimeError", 14: "ValueError", 40: "OSError", 50: "ValueError"}[r.id]
        else:
            assert r.embedding == pytest.approx(unit) and r.error is None
    loads = [p.split("-")[1] for p in os.listdir(tmp_path) if p.startswith("load")]
    assert len(loads) == len(set(loads)) <= 2  # once a worker process
    seen = sizes(tmp_path, "batch")  # 98 inputs, of which one fails: its batch is halved down to it; then three more
    assert sorted(seen) == sorted([16] * 6 + [2, 3] + [8, 8, 4, 4, 2, 2, 1, 1])


def test_a_model_that_gives_too_few(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string").coalesce(1)
    out = embed_rows(rows, "text", f"few {tmp_path}", lambda: None, str, lambda m, x: np.zeros((1, 2)) if len(x) > 1 else np.ones((1, 2)), normalise=False).collect()
    assert [(r.id, r.embedding) for r in out] == [(1, [1, 1]), (2, [1, 1])]
    assert embed_rows(rows.limit(0), "text", "none", lambda: 1 / 0, str, lambda m, x: x).collect() == []
