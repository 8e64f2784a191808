"""Folders on disk as tables, and the plans that upkeep makes of them: what to unpack, which times to set again."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from polyview.functions.staging import stage_table
from polyview.operators import maintenance as M
from polyview.operators.caches import tree_manifest
from polyview.operators.identity import skipped
from polyview.sources.apply import JOURNALS
from polyview.sources.archives import content_elsewhere, scan_archives


class TreeSource(DataSource):
    """``spark.read.format("tree").load(path)``: rel, is_dir, size and mtime_ns of all below a folder; each entry of the top two levels is a task's."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "rel string, is_dir boolean, size long, mtime_ns long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"])


class _TreeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out = []
        for top in sorted(os.listdir(self.path)) if os.path.isdir(self.path) else []:
            folder = os.path.join(self.path, top)
            out.append(InputPartition((top, False)))
            if os.path.isdir(folder) and not os.path.islink(folder):
                out += [InputPartition((os.path.join(top, n), True)) for n in sorted(os.listdir(folder))]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rel, deep = partition.value
        todo = [rel]
        while todo:
            at = todo.pop()
            try:
                s = os.lstat(os.path.join(self.path, at))
            except FileNotFoundError:
                continue  # it went meanwhile
            is_dir = os.path.isdir(os.path.join(self.path, at)) and not os.path.islink(os.path.join(self.path, at))
            yield at, is_dir, 0 if is_dir else s.st_size, s.st_mtime_ns
            if is_dir and deep:
                todo += [os.path.join(at, n) for n in os.listdir(os.path.join(self.path, at))]


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree below a folder, without journals of ``apply``."""
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("tree").load(root.rstrip("/"))
    return rows.filter((F.col("rel") != JOURNALS) & ~F.startswith("rel", F.lit(f"{JOURNALS}/")))


def unpack_plan(spark: SparkSession, root: str, every_variant: bool = False, repair: list[str] | None = None, check_elsewhere: bool = True) -> DataFrame:
    """zip, dest, action, bytes, replace of every zip below a local folder.

    Actions, first that holds: ``skip-tagged`` (a variant by its name, unless ``every_variant``), ``unreadable``, ``unsafe`` (an entry leaves its folder), ``repair`` (the
    destination holds something, but lacks files of the archive or has them at another size) or ``repair-held`` where no ``repair`` path names
    the zip or a folder above it, ``done``, ``elsewhere`` (its content lies below its folder in another layout; not asked of diverted zips),
    ``extract``.  Zips that claim one destination each go to a folder of their own name, whatever their action.
    """
    root = root.rstrip("/")
    tree = stage_table(scan_tree(spark, root), "tree")
    rows = stage_table(scan_archives(spark, root).withColumn("zip", F.substring("zip", len(root) + 2, 1 << 20)), "entries")
    zips = rows.groupBy("zip").agg(F.bool_and(F.col("error").isNull()).alias("readable"))
    empty = tree.filter(~F.col("is_dir") & F.lower("rel").endswith(".zip")).select(F.col("rel").alias("zip")).join(zips, "zip", "left_anti").withColumn("readable", F.lit(True))
    zips = zips.unionByName(empty)  # a zip without entries has no row of its own
    entries = rows.filter("error IS NULL")
    real = entries.filter("trim(BOTH '/' FROM name) <> ''")
    places = M.zip_destination(real).select("zip", "in_place", "unsafe", "bytes").join(real.groupBy("zip").agg(F.min(F.substring_index("name", "/", 1)).alias("top")), "zip")
    folder = F.regexp_extract("zip", "^(.*/)", 1)
    stem = F.regexp_replace("zip", "\\.[zZ][iI][pP]$", "")
    plans = zips.join(places, "zip", "left").withColumn("stem", stem).withColumn("own", F.when(F.col("in_place"), F.concat(folder, "top")).otherwise(stem))
    plans = plans.withColumn("own", F.when(F.col("readable"), F.col("own")))
    final = M.divert_collisions(plans.select("zip", F.col("own").alias("dest"), "stem"))
    plans = stage_table(plans.join(final, "zip").withColumn("diverted", F.col("dest") != F.col("own")), "plans")

    # what each destination holds, against its archive
    files = tree.filter("NOT is_dir").select("rel", F.col("size").alias("found"))
    wanted = real.filter("NOT is_dir").join(plans.select("zip", "dest", "in_place"), "zip")
    inner = F.when(F.col("in_place"), F.expr("substring(name, instr(name, '/') + 1)")).otherwise(F.col("name"))
    faults = wanted.withColumn("rel", F.concat_ws("/", "dest", inner)).join(files, "rel", "left").groupBy("zip").agg(F.bool_or(F.col("found").isNull() | (F.col("found") != F.col("size"))).alias("damaged"))
    held = tree.select(F.explode(M.ancestors(F.col("rel"))).alias("dest")).distinct().withColumn("present", F.lit(True))
    plans = plans.join(faults, "zip", "left").join(held, "dest", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    if check_elsewhere:
        plans = plans.join(content_elsewhere(spark, root).select(F.substring("zip", 3, 1 << 20).alias("zip"), "elsewhere"), "zip", "left")
    else:
        plans = plans.withColumn("elsewhere", F.lit(False))
    asked = spark.createDataFrame([(os.path.relpath(os.path.abspath(p), os.path.abspath(root)),) for p in repair or []], "path string")
    allowed = M.repair_authorised(plans.select("zip", F.col("zip").alias("path")), asked).select("zip", "authorised")
    everything = F.lit(any(os.path.abspath(root).startswith(os.path.abspath(p).rstrip("/") + "/") or os.path.abspath(p) == os.path.abspath(root) for p in repair or []))
    plans = plans.join(allowed, "zip").withColumn("authorised", F.col("authorised") | everything)
    no = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(skipped(M.base_name(F.col("stem"))) & ~F.lit(every_variant), "skip-tagged")
        .when(~F.col("readable"), "unreadable")
        .when(no("unsafe"), "unsafe")
        .when(F.col("present") & no("damaged"), F.when(F.col("authorised"), "repair").otherwise("repair-held"))
        .when(F.col("present"), "done")
        .when(no("elsewhere") & ~F.col("diverted"), "elsewhere")
        .otherwise("extract")
    )
    out = plans.withColumn("action", action)
    return out.select(F.concat(F.lit(f"{root}/"), "zip").alias("zip"), F.concat(F.lit(f"{root}/"), "dest").alias("dest"), "action", F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.col("action") == "repair").alias("replace"))


class TreesDiffer(ValueError):
    """Two trees are not copies of each other."""


def times_plan(spark: SparkSession, source: str, copy: str) -> DataFrame:
    """rel, is_dir, mtime_ns of what has another time in the copy than in the source.  Trees that differ in paths or sizes are refused."""
    a, b = (stage_table(tree_manifest(scan_tree(spark, p).withColumnRenamed("mtime_ns", "mtime")), "tree") for p in (source, copy))
    states = {r.state: r["count"] for r in M.compare_trees(a, b).groupBy("state").count().collect()}
    if wrong := {s: n for s, n in states.items() if s in ("missing", "extra", "size")}:
        raise TreesDiffer("the trees do not correspond: " + ", ".join(f"{n} {s}" for s, n in sorted(wrong.items())))
    now = b.select("rel", F.col("mtime").alias("now"))
    return a.join(now, "rel").filter("mtime <> now").select("rel", "is_dir", F.col("mtime").alias("mtime_ns"))
