"""Small JSON files beside a cache: the run's manifest, labels, published predictions, walks; and whose root a cache's keys hang on."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The axes of the six orientation candidates, in their order.
AXES = ["+Z", "-Z", "+Y", "-Y", "+X", "-X"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files (a file, folder or pattern); no rows where there is none."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The parameters that a run has recorded beside its cache; none if it has not.  A file that is torn or no object is an error."""
    rows = _whole(spark, path).take(1)
    if not rows:
        return {}
    found = json.loads(rows[0].text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a manifest must be an object, not {type(found).__name__}")
    return found


class RootMismatch(ValueError):
    """A cache's keys hang on another root than the one asked for."""


def anchored_root(asked: str, recorded: str | None, is_file: bool = False, read_only: bool = False, reanchor: bool = False) -> tuple[str, str | None]:
    """The root that keys are taken relative to, and a note.

    The root belongs to the cache: a run on a part of it (``subdir``), or on one file, keeps the recorded root.  A wider
    root (``superdir``) or another one (``mismatch``) would miss every entry: it is refused unless the caller reads only, or asks
    to re-anchor.  A job has nobody to ask.
    """
    asked = os.path.normpath(asked)
    if recorded is None:
        return (os.path.dirname(asked) if is_file else asked), None
    recorded = os.path.normpath(recorded)
    inside = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
    if is_file or asked == recorded:
        return recorded, None
    if inside(asked, recorded):
        return recorded, "subdir"
    note = "superdir" if inside(recorded, asked) else "mismatch"
    if not (read_only or reanchor):
        raise RootMismatch(f"the cache hangs on {recorded}, not on {asked} ({note}): its keys must be migrated, or re-anchored on purpose")
    return asked, note


def axis_index(up: Column) -> Column:
    """The candidate of an axis name; another name is an error."""
    index = F.create_map(*[F.lit(x) for k, a in enumerate(AXES) for x in (a, k)])
    return F.when(up.isNotNull(), F.coalesce(index[up], F.raise_error(F.concat(F.lit("no such axis: "), up)).cast("int")))


def read_labels(spark: SparkSession, path: str, which: str | None = None) -> DataFrame:
    """stem, path (below the file's own root), set, up and gold (the candidate's index) of a labels file, or of one of its sets."""
    schema = "collection_root string, labels array<struct<stem:string, path:string, set:string, up:string>>"
    rows = _whole(spark, path).select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("f")).select("f.collection_root", F.inline("f.labels"))
    rows = rows.select("stem", F.concat_ws("/", "collection_root", "path").alias("path"), "set", "up", axis_index(F.col("up")).alias("gold"))
    return rows if which is None else rows.filter(F.col("set") == which)


def arbiter_picks(published: DataFrame, dumps: DataFrame) -> DataFrame:
    """config, stem, pick of every recorded answer.

    ``published`` (stem, record): a prediction's JSON object, whose ``*_sheet*`` members with a text are answers.  ``dumps`` (json): objects of
    ``model@size`` by stem, null where none was given; they name the config ``model_sheetsize`` and take the place of published ones.
    """
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    wide = published.select("stem", F.explode(F.from_json("record", "map<string, variant>")).alias("config", "v"))
    first = wide.filter(F.contains("config", F.lit("_sheet"))).select("config", "stem", text(F.col("v")).alias("up"), F.lit(0).alias("rank"))
    runs = dumps.select(F.explode(F.from_json("json", "map<string, map<string, variant>>")).alias("run", "answers")).select("run", F.explode("answers").alias("stem", "v"))
    config = F.regexp_replace("run", "@([^@]*)$", "_sheet$1")
    both = first.unionByName(runs.select(config.alias("config"), "stem", text(F.col("v")).alias("up"), F.lit(1).alias("rank")))
    last = both.filter("up IS NOT NULL").groupBy("config", "stem").agg(F.max_by("up", F.struct("rank", "up")).alias("up"))
    return last.select("config", "stem", axis_index(F.col("up")).alias("pick"))


def newest_walk(spark: SparkSession, pattern: str) -> DataFrame:
    """path of every file of the walk that was scanned last, of all that match a pattern (the later name where two are as new)."""
    walks = _whole(spark, pattern).select("path", F.from_json("text", "scanned double, files array<string>").alias("w"))
    best = walks.agg(F.max(F.struct(F.coalesce("w.scanned", F.lit(0.0)).alias("scanned"), "path")).alias("b")).first()["b"]
    if best is None:
        raise FileNotFoundError(f"no walk matches {pattern}")
    return walks.filter(F.col("path") == best["path"]).select(F.explode("w.files").alias("path"))


def stored_embeddings(files: DataFrame, store: DataFrame) -> tuple[DataFrame, int]:
    """Rows (file, view, embedding) of files (file, embed_key) that a store (embed_key, view, embedding) holds, and how many files it lacks.

    A run on a part of a library meets files that were never embedded, so some may lack; if all do, that is an error.
    """
    keys = store.select("embed_key").distinct().withColumn("held", F.lit(True))
    n = files.join(keys, "embed_key", "left").agg(F.count_if("held").alias("kept"), F.count("*").alias("all")).first()
    if not n["kept"]:
        raise LookupError("none of the files has an embedding in the store")
    return files.join(store, "embed_key").select("file", "view", "embedding"), n["all"] - n["kept"]
