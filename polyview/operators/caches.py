"""Readers of cache files that never fail on one bad entry, listings, renders and old keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.operators.identity import skipped, walked

#: The pose format in force, and sources that were renamed.
POSE_VERSION = 4
RENAMED_SOURCES = {"heuristic": "geometry", "ensemble": "siglip"}
#: Prompts that a category's embedding is the mean of.
PROMPTS = ["a 3D render of a {} miniature", "a photo of a {} figurine", "a tabletop miniature of a {}"]


def pose_entries(files: DataFrame, strict: bool = True) -> DataFrame:
    """(file, key, source, entry) of the entries in force of pose cache files (file, json): objects of the current version.

    A version is a number (4 or 4.0, not the text "4").  A file that is torn or no object is an error that names it, or without ``strict`` has no
    entries; a null one has none.
    """
    whole = F.try_parse_json("json")
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("a pose cache must be a JSON object: "), F.col("file").cast("string"))).cast("map<string, variant>") if strict else F.lit(None)
    held = F.when(is_object, F.from_json("json", "map<string, variant>")).when(F.col("json").isNotNull(), bad)
    entries = files.select("file", F.explode(held).alias("key", "value")).select("file", "key", "value", F.to_json("value").alias("entry"))
    of = lambda name: F.get_json_object("entry", f"$.{name}")
    version = F.try_variant_get("value", "$.v", "variant")
    numeric = F.schema_of_variant(version).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    live = entries.filter(F.col("entry").startswith("{") & F.when(numeric, version.cast("double") == POSE_VERSION).otherwise(False))
    renamed = F.create_map(*[F.lit(x) for pair in RENAMED_SOURCES.items() for x in pair])
    return live.select("file", "key", F.coalesce(renamed[of("source")], of("source")).alias("source"), "entry")


def stamped_version(json: Column) -> Column:
    """The cache's version; whatever is missing or malformed counts as 0."""
    return F.coalesce(F.get_json_object(json, "$.cache_version").try_cast("int"), F.lit(0))


def elevations(text: Column) -> Column:
    """Camera elevations of '20,-10,55' in degrees; null where one is no number or beyond a right angle, or none is given."""
    parts = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    fine = (F.size(numbers) > 0) & F.forall(numbers, lambda e: F.coalesce(F.abs(e) <= 90, F.lit(False)))
    return F.when(fine, numbers)


def walk(paths: DataFrame, marker: str = "/") -> DataFrame:
    """Files of a listing (rel) that a walk keeps: no hidden or tagged folder on the way, an .stl that is neither."""
    parts = F.split("rel", marker)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    clear = F.forall(folders, lambda d: ~d.startswith(".") & ~skipped(d))
    name = F.element_at(parts, -1)
    return paths.filter(clear & walked(name) & ~skipped(name))


def cached_walk(cached: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Cached files (rel, scanned) that still exist, with the scan's age in days."""
    return cached.join(listing.select("rel"), "rel", "left_semi").select("rel", ((now - F.col("scanned")) / 86400).alias("age_days"))


def tree_manifest(listing: DataFrame) -> DataFrame:
    """rel, is_dir, size, mtime of a tree, folders with size 0, without the file system's own lost+found at the root."""
    own = (F.col("rel") == "lost+found") | F.col("rel").startswith("lost+found/")
    return listing.filter(~own).select("rel", "is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).cast("long").alias("size"), "mtime")


def render_state(models: DataFrame, renders: DataFrame, n_views: int) -> DataFrame:
    """Per model (key, front): whether all views are rendered, and the view to show: the front, else the first there is."""
    wanted = models.select("key", F.coalesce("front", F.lit(0)).alias("front"), F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))).alias("view"))
    have = renders.select("key", "view").distinct().withColumn("here", F.lit(True))
    met = wanted.join(have, ["key", "view"], "left")
    rank = F.when(F.col("here"), F.when(F.col("view") == F.col("front"), -1).otherwise(F.col("view")))
    return met.groupBy("key").agg(F.bool_and(F.col("here").isNotNull()).alias("complete"), F.min_by("view", rank).alias("shown"))


def old_keys(rel: Column, root: str, mtime_ns: Column, size: Column, absolute: bool) -> tuple[Column, Column]:
    """Identity and six digits of the render key as older caches spelled them: absolute ones with the path and whole nanoseconds."""
    base = F.concat(F.lit(f"{root}/"), rel) if absolute else rel
    ns = mtime_ns.cast("long")
    stamp = ns if absolute else ((ns - F.pmod(ns, F.lit(1_000_000_000))).cast("decimal(20,0)") / 1_000_000_000).cast("long")
    return F.concat_ws("|", base, stamp.cast("string"), size.cast("string")), F.substring(F.sha1(base.cast("binary")), 1, 6)


def render_moves(renders: DataFrame, keys: DataFrame) -> DataFrame:
    """(stem, target) of render files: a known old key is replaced before its ending, anything else is an orphan (null)."""
    split = renders.select("stem", F.regexp_extract("stem", "^(.+)_(view[0-9]+|pose)$", 1).alias("old_key"), F.regexp_extract("stem", "^(.+)_(view[0-9]+|pose)$", 2).alias("tail"))
    return split.join(keys, "old_key", "left").select("stem", F.when(F.col("new_key").isNotNull(), F.concat_ws("_", "new_key", "tail")).alias("target"))


def exclusive_times(spans: DataFrame) -> DataFrame:
    """Per stage, by total time: calls and time without that of the spans inside (id, parent, stage, seconds)."""
    inside = spans.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("seconds").alias("inside"))
    own = spans.join(inside, "id", "left").withColumn("own", F.col("seconds") - F.coalesce("inside", F.lit(0.0)))
    return own.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("own").alias("own")).orderBy(F.desc("own"), "stage")


def seeded_sample(rows: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """``n`` rows, the same ones for a seed (the limit is the feature)."""
    return rows.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))), id_col).limit(n)


def mark(pick: Column, gold: Column, names: list[str]) -> Column:
    """A pick's name, starred where it is wrong, -- where there is none."""
    return F.when(pick.isNull(), "--").otherwise(F.concat(F.get(F.array(*map(F.lit, names)), pick), F.when(pick.eqNullSafe(gold), "").otherwise("*")))


def mesh_bytes(vertices: Column, triangles: Column) -> Column:
    """Bytes that a mesh holds: points and both kinds of normals as doubles, corners as 32-bit numbers."""
    return vertices * 48 + triangles * 36


def prompts(category: Column) -> Column:
    return F.array(*[F.replace(F.lit(p), F.lit("{}"), category) for p in PROMPTS])
