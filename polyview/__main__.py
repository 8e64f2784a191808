"""Commands over the operators: ``python -m polyview COMMAND``.

``unpack`` and ``times`` change nothing without ``--apply``.  Views are Parquet tables (row_id, view, embedding), texts (text_id, embedding).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify(views: DataFrame, texts: DataFrame, mode: str, names: DataFrame | None = None) -> DataFrame:
    """row_id and its three best texts (smaller id on ties), as an array of (category, score)."""
    from polyview.operators.retrieval import pooled_scores

    scores = pooled_scores(views, texts, mode)
    scores = scores.join(names, "text_id") if names is not None else scores.withColumn("name", F.col("text_id").cast("string"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "text_id"))
    best = scores.withColumn("n", place).filter("n <= 3")
    held = F.array_sort(F.collect_list(F.struct("n", F.col("name").alias("category"), F.round("score", 4).alias("score"))))
    return best.groupBy("row_id").agg(F.transform(held, lambda x: F.struct(x["category"].alias("category"), x["score"].alias("score"))).alias("top"))


def _classify(spark: SparkSession, a: argparse.Namespace) -> int:
    from polyview.sources.sinks import write_results

    rows = classify(spark.read.parquet(a.views), spark.read.parquet(a.texts), a.pool)
    none = F.lit(None).cast("string")
    write_results(rows.select(F.col("row_id").alias("index"), F.col("row_id").cast("string").alias("file"), none.alias("error"), "top", *[none.alias(c) for c in ("up", "pose_conf", "pose_source", "front_view")]), a.out)
    return 0


def _cluster(spark: SparkSession, a: argparse.Namespace) -> int:
    from polyview.operators.cluster import clusters
    from polyview.sources.sinks import write_clusters

    write_clusters(clusters(spark.read.parquet(a.views), a.k).select(F.col("row_id").cast("string").alias("file"), "cluster", F.col("distance").alias("centroid_dist")), a.out)
    return 0


def _unpack(spark: SparkSession, a: argparse.Namespace) -> int:
    from polyview.operators.maintenance import action_totals
    from polyview.sources.apply import recover, unpack
    from polyview.sources.trees import unpack_plan

    for line in recover(spark, a.root) if a.apply else []:
        print(line)
    plan = unpack_plan(spark, a.root, a.all, a.repair, not a.ignore_elsewhere).cache()
    for r in action_totals(plan.withColumnRenamed("bytes", "size")).orderBy("action").collect():
        print(f"{r.action:<13} {r.n:>7} {r.bytes / 1e9:>9.2f} GB")
    todo = plan.filter("action IN ('extract', 'repair')").select("zip", "dest", "replace")
    if not a.apply:
        return 0
    outcomes = unpack(todo, a.root)
    for r in outcomes.groupBy(F.substring_index("outcome", ":", 1).alias("outcome")).count().orderBy("outcome").collect():
        print(f"{r.outcome:<13} {r['count']:>7}")
    bad = outcomes.filter("outcome <> 'unpacked'")
    for r in bad.limit(20).collect():
        print(f"  {r.zip}: {r.outcome}")
    return int(not bad.isEmpty())


def _times(spark: SparkSession, a: argparse.Namespace) -> int:
    from polyview.sources.apply import restore_times
    from polyview.sources.trees import TreesDiffer, times_plan

    try:
        plan = times_plan(spark, a.source, a.copy)
    except TreesDiffer as e:
        print(e)
        return 1
    counts = plan.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders")).first()
    print(f"{counts['files']} files and {counts['folders']} folders have other times")
    failed = restore_times(plan, a.copy).collect() if a.apply else []
    for r in failed[:20]:
        print(f"  {r.rel}: {r.error}")
    return int(bool(failed))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m polyview", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in arguments:
            c.add_argument(x)
        c.set_defaults(run=run)
        return c

    c = command("classify", _classify, "views", "texts", "out")
    c.add_argument("--pool", choices=("mean", "max", "softmax"), default="softmax")
    command("cluster", _cluster, "views", "out").add_argument("-k", type=int, default=10)
    c = command("unpack", _unpack, "root")
    c.add_argument("--all", action="store_true", help="variants too, which their names mark")
    c.add_argument("--apply", action="store_true")
    c.add_argument("--repair", action="append", default=[], metavar="PATH", help="replace the destination of this zip, or of those below this folder")
    c.add_argument("--ignore-elsewhere", action="store_true")
    command("times", _times, "source", "copy").add_argument("--apply", action="store_true")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("polyview").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
