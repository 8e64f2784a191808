"""The query service: bounds, codes, hits, and one snapshot a request."""

import pytest

from polyview.operators.service import Refused, Service, Snapshot


@pytest.fixture(scope="module")
def service(spark):
    def load(generation):
        if generation == 3:
            raise ValueError("torn")
        views = spark.createDataFrame([(i, v, [float(i % 3 == a) + i / 100 for a in range(3)]) for i in range(6) for v in range(2)], "row_id long, view int, embedding array<double>")
        models = spark.createDataFrame([(i, f"kit{i % 2}/No Supports/m{i}.stl", i < 6) for i in range(8)] + [(9, "bare/x.stl", False)], "row_id long, rel string, indexed boolean")
        return Snapshot(views, models, spark.createDataFrame([(1, "z")], "row_id long, pose string"), "/lib", generation)

    s = Service(lambda texts, raw: [[0.0, 1.0, 0.0]] * len(texts), load)
    with pytest.raises(Refused) as e:
        s.query("x")
    assert e.value.status == 503 and not s.status()["ready"]
    assert s.reload()["n_models"] == 6
    return s


@pytest.mark.parametrize("status, request_", [(422, {"top": 0}), (422, {"top": True}), (422, {"cap": 10001}), (422, {"pool": "median"}), (422, {"path": "/lib/a.zip!/b"}), (400, {"path": "/library"}), (404, {"path": "/lib/none"})])
def test_refusals(service, status, request_):
    with pytest.raises(Refused) as e:
        service.query("text", **request_)
    assert e.value.status == status


def test_hits(service):
    got = service.query("text", top=2)
    assert [h["rel_path"] for h in got["results"]] == ["kit0/No Supports/m4.stl", "kit1/No Supports/m1.stl"]
    assert got["results"][1] | {"score": 0, "z": 0, "id": ""} == {"id": "", "path": "/lib/kit1/No Supports/m1.stl", "rel_path": "kit1/No Supports/m1.stl", "name": "kit1/m1", "score": 0, "z": 0, "pose": "z"}
    assert got["scope"] == {"path": None, "status": "partial", "n_indexed": 6, "n_scanned": 9} and got["truncated"] is False
    cut = service.query("text", min_score=-5.0, cap=3)
    assert cut["truncated"] is True and len(cut["results"]) == 3
    assert service.query("text", path="/lib/bare") == {"scope": {"path": "/lib/bare", "status": "unindexed", "n_indexed": 0, "n_scanned": 1}, "weak": False, "best_z": None, "truncated": False, "results": []}


def test_similar(service):
    got = service.similar("/lib/kit1/No Supports/m1.stl", k=3)
    assert got["results"][0]["name"] == "kit0/m4" and all(h["name"] != "kit1/m1" for h in got["results"])
    for path, status in (("/lib/bare/x.stl", 404), ("/lib/kit1", 422)):
        with pytest.raises(Refused) as e:
            service.similar(path)
        assert e.value.status == status


def test_reload_keeps_the_old_snapshot_when_it_fails(service):
    assert service.reload()["generation"] == 2
    with pytest.raises(Refused, match="ValueError: torn") as e:
        service.reload()
    after = service.status()
    assert e.value.status == 409 and after["ready"] and after["generation"] == 2 and after["failure"] == "ValueError: torn" and service.query("t", top=1)["results"]


def test_reload_without_a_snapshot_and_with_a_walk():
    walked = []

    def load(generation):
        raise OSError("volume is gone")

    service = Service(lambda texts, raw: [], load, lambda: walked.append(1))
    for rescan in (False, True):
        with pytest.raises(Refused, match="volume is gone") as e:
            service.reload(rescan=rescan)
        assert e.value.status == 503
    assert walked == [1] and service.status()["failure"] == "OSError: volume is gone"
