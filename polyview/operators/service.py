"""The query service as plain functions: requests are checked, a snapshot is bound once, answers are dictionaries.

A web server of the user's choice maps its routes to ``Service.query``, ``similar``, ``status`` and ``reload``, and ``Refused`` to its status.
Only an answer's hits (at most ``cap`` rows) and one row of counts come to the driver.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.operators import retrieval as R
from polyview.operators.identity import display_name, render_key

POOLS = ("mean", "max", "softmax")


class Refused(ValueError):
    """A request that gets no answer, with its HTTP status."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


@dataclass(frozen=True)
class Snapshot:
    """Tables that belong together: views (row_id, view, embedding), models (row_id, rel, indexed), poses (row_id, pose)."""

    views: DataFrame
    models: DataFrame
    poses: DataFrame
    root: str
    generation: int = 0


def checked(name: str, value: object, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise Refused(422, f"{name} must be a whole number from {low} to {high}")
    return value


def hits(ranked: DataFrame, snapshot: Snapshot, *more: str) -> DataFrame:
    """Ranked rows with what a caller sees of a model: key, paths, name and pose; ``more`` names columns that stay."""
    models = snapshot.models.select("row_id", render_key(F.col("rel")).alias("id"), F.concat(F.lit(f"{snapshot.root}/"), "rel").alias("path"), F.col("rel").alias("rel_path"), display_name(F.col("rel")).alias("name"))
    return F.broadcast(ranked).join(models, "row_id").join(snapshot.poses, "row_id", "left").select(*more, "rank", "id", "path", "rel_path", "name", "score", "z", "pose")


class Service:
    """Answers from one snapshot at a time; ``embed`` turns texts into vectors, ``load`` builds the next snapshot."""

    def __init__(self, embed: Callable[[Sequence[str], bool], Sequence[Sequence[float]]], load: Callable[[int], Snapshot], rescan: Callable[[], None] = lambda: None):
        self._embed, self._load, self._rescan, self._lock = embed, load, rescan, threading.Lock()
        self._snapshot: Snapshot | None = None
        self._failure: str | None = None

    def reload(self, rescan: bool = False) -> dict:
        """Bind a new snapshot, after walking the collection again if ``rescan``; meanwhile the old one goes on answering.

        A failure is kept for ``status`` and refused: 409 where an old snapshot still answers, 503 where there is none.
        """
        with self._lock:
            generation = self._snapshot.generation + 1 if self._snapshot else 1
            try:
                if rescan:
                    self._rescan()
                self._snapshot, self._failure = self._load(generation), None
            except Exception as e:
                self._failure = f"{type(e).__name__}: {e}".split("\n")[0]
                raise Refused(409 if self._snapshot else 503, self._failure) from e
        return self.status()

    def _bound(self) -> Snapshot:
        snapshot = self._snapshot  # read once: a reload in between changes nothing of this request
        if snapshot is None:
            raise Refused(503, self._failure or "not loaded")
        return snapshot

    def _scope(self, s: Snapshot, path: str | None) -> tuple[DataFrame, dict]:
        """Models in a scope, and its counts; the codes are those of ``scope_code``."""
        rel = None
        if path is not None:
            if "!/" in path:
                raise Refused(422, f"{path} is inside an archive")
            if path != s.root and not path.startswith(f"{s.root}/"):
                raise Refused(400, f"{path} is outside {s.root}")
            rel = path[len(s.root) + 1 :].rstrip("/") or None
        models = s.models.filter(R.in_scope(F.col("rel"), rel))
        n = models.agg(F.count("*").alias("all"), F.count_if("indexed").alias("indexed")).first()
        if not n["all"] and rel is not None:
            raise Refused(404, f"no such path: {path}")
        status = "unindexed" if not n["indexed"] else "indexed" if n["indexed"] >= n["all"] else "partial"
        return models, {"path": path, "status": status, "n_indexed": n["indexed"], "n_scanned": n["all"]}

    @staticmethod
    def _answer(rows: DataFrame, s: Snapshot) -> list[dict]:
        return [{k: v for k, v in r.asDict(True).items() if k != "rank"} for r in hits(rows, s).orderBy("rank").collect()]

    def query(self, text: str, path: str | None = None, raw: bool = False, pool: str | None = None, top: int = 10, min_score: float | None = None, cap: int = 500) -> dict:
        top, cap = checked("top", top, 1, 1000), checked("cap", cap, 1, 10000)
        if pool is not None and pool not in POOLS:
            raise Refused(422, f"pool must be one of {', '.join(POOLS)}")
        s = self._bound()
        models, scope = self._scope(s, path)
        if not scope["n_indexed"]:  # before the text is embedded
            return {"scope": scope, "weak": False, "best_z": None, "truncated": False, "results": []}
        vector = [float(x) for x in self._embed([text], raw)[0]]
        texts = s.views.sparkSession.createDataFrame([(0, vector)], "text_id int, embedding array<double>")
        scored = R.robust_z(R.pooled_scores(s.views.join(models.select("row_id"), "row_id", "left_semi"), texts, pool or "softmax"))
        best = R.verdict(scored).first()
        ranked = R.rank(scored, top=top, min_score=min_score)
        results = self._answer(ranked.orderBy("rank").limit(cap + 1), s)
        return {"scope": scope, "weak": best["weak"], "best_z": best["best_z"], "truncated": len(results) > cap, "results": results[:cap]}

    def similar(self, path: str, scope: str | None = None, pool: str | None = None, k: int = 10) -> dict:
        k = checked("k", k, 1, 1000)
        if pool is not None and pool not in POOLS:
            raise Refused(422, f"pool must be one of {', '.join(POOLS)}")
        s = self._bound()
        target, found = self._scope(s, path)
        if not found["n_indexed"]:
            raise Refused(404, f"{path} is not in the cache")
        if found["n_indexed"] > 1:
            raise Refused(422, f"{path} names {found['n_indexed']} models, not one")
        row_id = target.filter("indexed").first()["row_id"]
        models, counts = self._scope(s, scope)
        inside = models.select("row_id").union(target.select("row_id")).distinct()
        ranked = R.similar(s.views.join(inside, "row_id", "left_semi"), row_id, pool or "softmax", k)
        return {"scope": counts, "results": self._answer(ranked, s)}

    def status(self) -> dict:
        s = self._snapshot
        out = {"ready": s is not None, "failure": self._failure, "generation": s.generation if s else None, "root": s.root if s else None}
        n = s.models.agg(F.count_if("indexed").alias("n"), F.count_if(~F.col("indexed")).alias("missing")).first() if s else None
        return out | {"n_models": n["n"] if n else None, "missing": n["missing"] if n else None}
