"""The routes over a real socket."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from polyview.operators.routes import serve
from polyview.operators.service import Service, Snapshot


@pytest.fixture(scope="module")
def ask(spark):
    state = {"fail": True}

    def load(generation):
        if state["fail"]:
            raise OSError("volume is gone")
        views = spark.createDataFrame([(i, v, [float(i % 3 == a) + i / 100 for a in range(3)]) for i in range(4) for v in range(2)], "row_id long, view int, embedding array<double>")
        models = spark.createDataFrame([(i, f"kit{i % 2}/m{i}.stl", True) for i in range(4)], "row_id long, rel string, indexed boolean")
        return Snapshot(views, models, spark.createDataFrame([], "row_id long, pose string"), "/lib", generation)

    server = serve(Service(lambda texts, raw: [[0.0, 1.0, 0.0]] * len(texts), load))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, raw=None):
        data = raw if raw is not None else None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", data, timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    ask.state = state
    yield ask
    server.shutdown()


def test_a_server_from_its_start(ask):
    assert ask("/status") == (200, {"ready": False, "failure": None, "generation": None, "root": None, "n_models": None, "missing": None})
    assert ask("/query", {"text": "x"})[0] == 503
    assert ask("/reload", {}) == (503, {"detail": {"ready": False, "failure": "OSError: volume is gone"}})
    ask.state["fail"] = False
    assert ask("/reload", {"rescan": True})[1]["n_models"] == 4
    status, got = ask("/query", {"text": "x", "top": 2, "unknown": 1})
    assert status == 200 and [h["rel_path"] for h in got["results"]] == ["kit1/m1.stl", "kit1/m3.stl"]
    assert ask("/similar", {"path": "/lib/kit1/m1.stl", "k": 1})[1]["results"][0]["rel_path"] != "kit1/m1.stl"
    ask.state["fail"] = True
    assert ask("/reload") == (405, {"detail": "Method Not Allowed"})
    assert ask("/reload", {}) == (409, {"detail": {"reloaded": False, "ready": True, "failure": "OSError: volume is gone"}})
    assert ask("/status")[1]["ready"] and ask("/query", {"text": "x", "top": 1})[0] == 200


@pytest.mark.parametrize(
    ("path", "body", "status"),
    [("/query", {}, 422), ("/query", {"text": 3}, 422), ("/query", {"text": "x", "top": True}, 422), ("/query", {"text": "x", "top": 0}, 422), ("/query", {"text": "x", "raw": 1}, 422), ("/query", {"text": "x", "pool": "median"}, 422), ("/query", {"text": "x", "min_score": "a"}, 422), ("/query", [1], 422), ("/query", {"text": "x", "path": "/other"}, 400), ("/query", {"text": "x", "path": "/lib/none"}, 404), ("/similar", {"path": "/lib/kit1"}, 422), ("/reload", {"rescan": "yes"}, 422), ("/nothing", {}, 404), ("/status", {}, 405)],
)
def test_refusals(ask, path, body, status):
    ask.state["fail"] = False
    ask("/reload", {})
    assert ask(path, body)[0] == status


def test_no_json(ask):
    assert ask("/query", raw=b"{torn")[0] == 422
