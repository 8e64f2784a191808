"""Text-to-model and model-to-model search: similarity, pooling over views, robust z, rank, scope."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from polyview.functions.order import medians
from polyview.functions.staging import stage_table
from polyview.functions.vectors import dot

POOLS = ("mean", "max", "softmax")
BETA = 50.0
WEAK_Z = 2.0


def similarities(views: DataFrame, texts: DataFrame, broadcast_texts: int = 10_000) -> DataFrame:
    """row_id, view, text_id, sim for every view and text.  A stated query set, sent to all views while it is small."""
    side = texts.select("text_id", F.col("embedding").alias("text"))
    if texts.limit(broadcast_texts + 1).count() <= broadcast_texts:
        side = F.broadcast(side)
    return views.crossJoin(side).select("row_id", "view", "text_id", dot("embedding", "text").alias("sim"))


def pool(sims: DataFrame, mode: str, by: list[str]) -> DataFrame:
    """One score per group: mean, max, or softmax-weighted mean with the largest value taken off first."""
    if mode not in POOLS:
        raise ValueError(f"unknown pool {mode!r}")
    if mode != "softmax":
        return sims.groupBy(*by).agg((F.avg if mode == "mean" else F.max)("sim").alias("score"))
    top = F.max("sim").over(Window.partitionBy(*by))
    weighted = sims.withColumn("w", F.exp(BETA * (F.col("sim") - top)))
    return weighted.groupBy(*by).agg((F.sum(F.col("w") * F.col("sim")) / F.sum("w")).alias("score"))


def _pooled(sims: np.ndarray, starts: np.ndarray, mode: str) -> np.ndarray:
    """Rows of ``sims`` pooled over segments that begin at ``starts``."""
    if mode == "max":
        return np.maximum.reduceat(sims, starts, axis=0)
    sizes = np.diff(np.append(starts, len(sims)))
    if mode == "mean":
        return np.add.reduceat(sims, starts, axis=0) / sizes[:, None]
    weights = np.exp(BETA * (sims - np.repeat(np.maximum.reduceat(sims, starts, axis=0), sizes, axis=0)))
    return np.add.reduceat(weights * sims, starts, axis=0) / np.add.reduceat(weights, starts, axis=0)


def _score_blocks(column: pa.Array, texts: np.ndarray, mode: str, cells: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row behind the last, scores) of stacks of view vectors, some rows at a time so that a block has about ``cells`` numbers."""
    offsets = column.offsets.to_numpy()
    inner = column.values
    flat, dim = inner.values.to_numpy(zero_copy_only=False), texts.shape[1]
    if (np.diff(inner.offsets.to_numpy()) != dim).any():
        raise ValueError(f"every view must have {dim} numbers, as the texts have")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + cells // max(len(texts), 1), side="right")) - 1)
        vectors = flat[inner.offsets[0].as_py() :][offsets[first] * dim : offsets[last] * dim].reshape(-1, dim)
        yield first, last, _pooled(vectors @ texts.T, offsets[first:last] - offsets[first], mode)
        first = last


def stacked(views: DataFrame) -> DataFrame:
    """row_id and the vectors of its views in order of view: one row a model."""
    fine = views.filter("row_id IS NOT NULL AND embedding IS NOT NULL").select("row_id", F.struct("view", F.col("embedding").cast("array<double>").alias("e")).alias("v"))
    return fine.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["e"]).alias("stack"))


def pooled_scores(views: DataFrame, texts: DataFrame, mode: str = "softmax", twice: bool = False, most_bytes: int = 64 << 20, block: int = 2048) -> DataFrame:
    """row_id, text_id, score: each model's views against each text, pooled over the views; ``pool(similarities(...))`` by matrix products.

    A model's stack and all texts meet in one product and only pooled scores leave it.  Texts are a stated set: up to ``most_bytes`` of
    them go to every task, which is measured first; beyond, stacks and texts meet in blocks of ``block`` texts by 4096 models.
    With ``twice`` the scores are pooled over the texts too (text_id is then 0); that needs them together.
    """
    if mode not in POOLS:
        raise ValueError(f"unknown pool {mode!r}")
    kind = texts.select("text_id").schema[0].dataType
    schema = f"row_id long, text_id {'int' if twice else kind.simpleString()}, score double"
    texts = stage_table(texts.filter("embedding IS NOT NULL").select("text_id", F.col("embedding").cast("array<double>").alias("embedding")), "texts")  # measured, then read
    stacks = stacked(views).select(F.col("row_id").cast("long").alias("row_id"), "stack")

    def rows(ids: pa.Array, column: pa.Array, text_ids: pa.Array, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b, scores in _score_blocks(column, matrix, mode):
            if twice:
                scores = _pooled(scores.T, np.array([0]), mode).T
            names = pa.array([0], pa.int32()) if twice else text_ids
            n, m = scores.shape
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(np.repeat(np.arange(n), m))), names.take(pa.array(np.tile(np.arange(m), n))), pa.array(scores.reshape(-1))], names=["row_id", "text_id", "score"])

    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("numbers")).first()
    if not size["n"]:
        return texts.sparkSession.createDataFrame([], schema)
    if twice or size["numbers"] * 8 <= most_bytes:
        held = texts.orderBy("text_id").collect()  # no more than most_bytes
        text_ids, matrix = pa.array([t["text_id"] for t in held], to_arrow_type(kind)), np.array([t["embedding"] for t in held], np.float64)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from rows(batch.column(0), batch.column(1), text_ids, matrix)

        return stacks.mapInArrow(score, schema)
    parts = max(1, -(-stacks.count() // 4096))
    blocks = -(-size["n"] // block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = texts.withColumn("b", F.pmod(F.xxhash64("text_id"), F.lit(blocks)).cast("int")).withColumn("p", each(parts))
    models = stacks.withColumn("q", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int")).withColumn("c", each(blocks))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row_id": pa.array([], pa.int64()), "text_id": pa.array([], left.schema.field("text_id").type), "score": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        matrix = np.array(left.column("embedding").to_pylist(), np.float64)
        return pa.Table.from_batches(list(rows(right.column("row_id").chunk(0), right.column("stack").chunk(0), left.column("text_id").chunk(0), matrix)))

    return asked.groupBy("b", "p").cogroup(models.groupBy("c", "q")).applyInArrow(meet, schema)


def robust_z(scores: DataFrame, by: str = "text_id") -> DataFrame:
    """Adds z against the median and the scaled median deviation of the scoped scores; a flat scope has z 0.

    Scores are written once.  Two exact medians from counts of narrow bins, a row for each of the few keys, are written too and joined back: no text's
    scores meet in one task, and nothing is scored again.
    """
    scores = stage_table(scores, "scores")
    mids = stage_table(medians(scores, by, "score"), "mids")
    off = scores.join(mids, by).withColumn("off", F.abs(F.col("score") - F.col("mid")))
    spread = stage_table(medians(off, by, "off").select(by, (F.col("mid") * 1.4826 + 1e-9).alias("spread")), "spreads")
    return scores.join(mids, by).join(spread, by).withColumn("z", (F.col("score") - F.col("mid")) / F.col("spread")).drop("mid", "spread")


def rank(scores: DataFrame, top: int | None = 10, min_score: float | None = None, cap: int | None = None, by: str = "text_id") -> DataFrame:
    """Stable descending rank, ties to the smaller row_id; min_score takes the place of top, cap cuts either."""
    if min_score is not None:
        scores = scores.filter(F.col("score") >= min_score)  # what is left out ranks behind, so no rank changes
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "row_id")))
    ranked = ranked.filter(F.col("rank") <= top) if min_score is None and top else ranked
    return ranked.filter(F.col("rank") <= cap) if cap else ranked


def verdict(scores: DataFrame, by: str = "text_id") -> DataFrame:
    """Best row and its z per text, before any cut; weak if that z is under 2."""
    best = scores.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "row_id"))).filter("n = 1")
    return best.select(by, F.col("row_id").alias("best"), F.col("z").alias("best_z"), (F.col("z") < WEAK_Z).alias("weak"))


def similar(views: DataFrame, target: int, pool_mode: str = "softmax", k: int = 10) -> DataFrame:
    """Models like a target: candidate views are pooled first, then the target's views; the target leaves before z."""
    own = views.filter(F.col("row_id") == target).select(F.col("view").alias("text_id"), "embedding")
    scores = pooled_scores(views.filter(F.col("row_id") != target), own, pool_mode, twice=True)
    return rank(robust_z(scores), top=k)


def in_scope(rel: Column, path: str | None) -> Column:
    """Whole path parts only: a sibling whose name begins alike is outside."""
    return F.lit(True) if not path else (rel == path) | rel.startswith(path + "/")


def scope_summary(models: DataFrame, paths: list[str]) -> DataFrame:
    """n_indexed, n_scanned and status of each path that holds a model: one scan, models meet paths by their folders."""
    asked = F.array(*map(F.lit, paths))
    parts = F.split("rel", "/")
    scopes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    out = models.select(F.explode(F.array_intersect(scopes, asked)).alias("path"), "indexed").groupBy("path").agg(F.count_if("indexed").alias("n_indexed"), F.count("*").alias("n_scanned"))
    status = F.when(F.col("n_indexed") == 0, "unindexed").when(F.col("n_indexed") >= F.col("n_scanned"), "indexed").otherwise("partial")
    return out.withColumn("status", status)


def scope_code(path: Column, root: Column, exists: Column) -> Column:
    """HTTP status for a requested path: virtual 422, outside 400, missing 404."""
    inside = (path == root) | path.startswith(F.concat(root, F.lit("/")))
    return F.when(path.isNull(), 200).when(path.contains("!/"), 422).when(~inside, 400).when(~exists, 404).otherwise(200)


def find(models: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    hit = models.filter(F.contains(F.lower("rel"), F.lit(needle.lower())))
    return hit.orderBy("rel").limit(limit).crossJoin(hit.agg(F.count("*").alias("total")))
