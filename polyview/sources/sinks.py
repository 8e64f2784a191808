"""Written results: the results and cluster CSVs, reports, and versioned snapshots that readers switch to at once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.functions.commits import Commits

#: The columns of the results CSV, in order.
RESULT_COLUMNS = ["file", "top1", "score1", "top2", "score2", "top3", "score3", "up", "pose_conf", "pose_source", "front_view"]


def result_rows(results: DataFrame) -> DataFrame:
    """Rows of the results CSV in order of index.  A row with ``error`` has its file and the error only.

    ``results``: index, file, error, top (array of category, score structs, best first), up, pose_conf, pose_source, front_view.
    """
    fine = F.col("error").isNull()
    columns = {"file": F.col("file")}
    for k in (1, 2, 3):
        columns[f"top{k}"] = F.when(fine, F.get("top", F.lit(k - 1))["category"])
        columns[f"score{k}"] = F.when(fine, F.get("top", F.lit(k - 1))["score"])
    columns |= {c: F.when(fine, F.col(c)) for c in RESULT_COLUMNS[7:]}
    columns["top1"] = F.when(fine, columns["top1"]).otherwise(F.concat(F.lit("RENDER_ERROR: "), F.col("error")))
    return results.orderBy("index").select(*[columns[c].alias(c) for c in RESULT_COLUMNS])


def write_results(results: DataFrame, path: str) -> None:
    """The whole CSV anew; its part files follow the order of index, so no task sees all rows."""
    result_rows(results).write.mode("overwrite").option("header", True).csv(path)


def write_clusters(members: DataFrame, path: str) -> None:
    """file, cluster, centroid_dist (4 decimals)."""
    members.select("file", "cluster", F.round("centroid_dist", 4).alias("centroid_dist")).orderBy("cluster", "centroid_dist", "file").write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_snapshot(rows: DataFrame, base: str) -> None:
    """Write a new version below ``base`` and number it last, so that readers see the old one or the new one whole."""
    place = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/{place}")
    Commits(rows.sparkSession, base).add({"place": place})


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The version with the greatest number, whatever the writers' clocks say."""
    return spark.read.parquet(f"{base}/{Commits(spark, base).entries()[-1]['place']}")


def write_stamp(spark: SparkSession, base: str, version: int, note: str = "") -> None:
    """The cache's version; write it after all else, so that a torn run keeps the old one."""
    write_snapshot(spark.range(1).select(F.lit(version).alias("version"), F.lit(note).alias("note")).coalesce(1), base)


def append_embeddings(rows: DataFrame, path: str) -> None:
    """Add rows (embed_key, view, embedding) whose key the store does not hold; a failed job leaves no torn entry."""
    try:
        held = rows.sparkSession.read.schema(rows.schema).parquet(path).select("embed_key").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    fresh = rows.dropDuplicates(["embed_key", "view"])
    (fresh if held is None else fresh.join(held, "embed_key", "left_anti")).write.mode("append").parquet(path)


def restore_plan(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The order in which times of (rel, is_dir, mtime) are set again: files first, then folders, deepest first; only where they differ."""
    both = src.join(dst.select("rel", F.col("mtime").alias("now")), "rel").filter("mtime <> now")
    depth = F.size(F.split("rel", "/"))
    return both.select("rel", "is_dir", "mtime", depth.alias("depth")).orderBy("is_dir", F.desc("depth"), "rel")
