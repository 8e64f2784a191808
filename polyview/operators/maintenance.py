"""Cache upkeep as joins: rekeying, orphans, tree comparison, archive planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.functions.staging import drop_table, stage_table
from polyview.operators.identity import escapes


def rekey(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (rel, old_key, new_key) against cache (key, value): the new key's entry wins over the old one's."""
    new, old = cache.select(F.col("key").alias("new_key"), F.col("value").alias("new_value")), cache.select(F.col("key").alias("old_key"), F.col("value").alias("old_value"))
    both = files.join(new, "new_key", "left").join(old, "old_key", "left")
    action = F.when(F.col("new_value").isNotNull() & F.col("old_value").isNotNull(), "superseded").when(F.col("new_value").isNotNull(), "already").when(F.col("old_value").isNotNull(), "moved").otherwise("missing")
    return both.select("rel", F.coalesce("new_value", "old_value").alias("value"), action.alias("action"))


def orphans(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache entries that no file claims under either key."""
    claimed = files.select(F.explode(F.array("old_key", "new_key")).alias("key"))
    return cache.join(claimed, "key", "left_anti")


def compare_trees(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(rel, state) of rel, size, mtime trees: missing, extra, size, mtime or same."""
    a = src.select("rel", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"))
    b = dst.select("rel", F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"))
    state = F.when(F.col("d_size").isNull(), "missing").when(F.col("s_size").isNull(), "extra").when(F.col("s_size") != F.col("d_size"), "size").when(F.col("s_mtime") != F.col("d_mtime"), "mtime").otherwise("same")
    return a.join(b, "rel", "full_outer").select("rel", state.alias("state"))


def newest_render(renders: DataFrame) -> DataFrame:
    """Render index: newest file of a stem wins, the later path on equal times."""
    return renders.groupBy("stem").agg(F.max(F.struct("mtime", "path")).alias("m")).select("stem", F.col("m.path").alias("path"), F.col("m.mtime").alias("mtime"))


def zip_destination(entries: DataFrame) -> DataFrame:
    """Per zip: whether all entries share one root folder and lie inside one (then it unpacks beside the zip)."""
    top = F.element_at(F.split("name", "/"), 1)
    return entries.groupBy("zip").agg((F.countDistinct(top) == 1).alias("one_root"), F.bool_and(F.contains("name", F.lit("/"))).alias("nested"), F.bool_or(escapes(F.col("name"))).alias("unsafe"), F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("in_place", F.col("one_root") & F.col("nested"))


def zip_action(skip: Column, readable: Column, unsafe: Column, damaged: Column, authorised: Column, present: Column, elsewhere: Column) -> Column:
    """What to do with a zip, in order of precedence."""
    return F.when(skip, "skip-tagged").when(~readable, "unreadable").when(unsafe, "unsafe").when(damaged & authorised, "repair").when(present & ~damaged, "done").when(elsewhere, "elsewhere").otherwise("extract")


#: Presentation files, whose absence asks for no new extraction, and folders of unfinished work.
JUNK_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".pdf", ".db", ".url"]
UNFINISHED = "(?:^|/)[^/]*\\.(?:partial|replaced)/"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_junk(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), "(?<=[^.])\\.[^.]+$", 0)).isin(JUNK_SUFFIXES)


def in_unfinished(path: Column) -> Column:
    return path.rlike(UNFINISHED)


def ancestors(path: Column) -> Column:
    """Every folder above a relative path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def damaged(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Archive entries (zip, rel, size) that the destination's files (zip, rel, size) lack or hold at another size."""
    have = files.select("zip", "rel", F.col("size").alias("found"))
    return entries.join(have, ["zip", "rel"], "left").filter("found is null or found <> size").select("zip", "rel", F.when(F.col("found").isNull(), "missing").otherwise("size").alias("fault"))


def spread_sample(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most ``n`` rows of every group, evenly spaced over its order from the first on."""
    w = Window.partitionBy(by)
    placed = rows.withColumn("_nth", F.row_number().over(w.orderBy(order)) - 1).withColumn("_step", F.ceil(F.count("*").over(w) / n))
    return placed.filter((F.col("_nth") % F.col("_step") == 0) & (F.col("_nth") < n * F.col("_step"))).drop("_nth", "_step")


def content_elsewhere(entries: DataFrame, files: DataFrame, sample: int = 5) -> DataFrame:
    """(zip, elsewhere): whether a zip's content already lies below the zip's folder, in whatever layout.

    ``entries``: zip, parent, place, name, size, crc; ``files``: path, size, crc.  Every entry but junk must be found by base name and
    size, and an evenly spread sample of them by checksum; files of unfinished swaps do not count.  A zip without such
    entries is not elsewhere.
    """
    real = entries.filter(~is_junk(F.col("name"))).select("zip", "parent", "place", base_name(F.col("name")).alias("base"), "size", "crc")
    found = files.filter(~in_unfinished(F.col("path"))).select(F.explode(ancestors(F.col("path"))).alias("parent"), base_name(F.col("path")).alias("base"), "size", "crc")
    by_size = found.select("parent", "base", "size").distinct().withColumn("here", F.lit(True))
    by_crc = found.distinct().withColumn("same", F.lit(True))
    sized = real.join(by_size, ["parent", "base", "size"], "left").groupBy("zip").agg(F.bool_and(F.col("here").isNotNull()).alias("here"))
    checked = spread_sample(real, "zip", "place", sample).join(by_crc, ["parent", "base", "size", "crc"], "left").groupBy("zip").agg(F.bool_and(F.col("same").isNotNull()).alias("same"))
    zips = entries.select("zip").distinct()
    return zips.join(sized, "zip", "left").join(checked, "zip", "left").select("zip", (F.coalesce("here", F.lit(False)) & F.coalesce("same", F.lit(False))).alias("elsewhere"))


def repair_authorised(zips: DataFrame, wanted: DataFrame) -> DataFrame:
    """(zip, path, authorised): whether a zip is, or lies under, one of the wanted paths; joined on its folders."""
    asked = wanted.select(F.col("path").alias("folder")).distinct()
    under = zips.select("zip", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("folder")).join(asked, "folder", "left_semi").select("zip").distinct()
    return zips.join(under.withColumn("hit", F.lit(True)), "zip", "left").select("zip", "path", F.col("hit").isNotNull().alias("authorised"))


def divert_collisions(plans: DataFrame) -> DataFrame:
    """zip, dest of plans (zip, dest, stem): all zips that claim one destination go to their own stem, until nobody else's is met.

    A diverted zip never moves again, so every round but the last moves one zip at least; each round is written, and the last one's table goes.
    Zips without a destination stay without.
    """
    plans = stage_table(plans.select("zip", "dest", "stem", F.lit(False).alias("moves")), "plans")
    while True:
        contested = plans.filter("dest is not null").groupBy("dest").agg(F.count("*").alias("n")).filter("n > 1").select("dest", F.lit(True).alias("contested"))
        moved = plans.join(contested, "dest", "left").select("zip", F.when(F.col("contested"), F.col("stem")).otherwise(F.col("dest")).alias("dest"), "stem", (F.coalesce("contested", F.lit(False)) & (F.col("dest") != F.col("stem"))).alias("moves"))
        last, plans = plans, stage_table(moved, "plans")
        drop_table(last)
        if plans.filter("moves").isEmpty():
            return plans.select("zip", "dest")


def merge_manifest(old: DataFrame, new: DataFrame, allowed: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Non-null new values over old ones, allowed keys only (key, value rows; ``by`` names the manifest where there are several)."""
    a, b = old.select(*by, "key", F.col("value").alias("was")), new.select(*by, "key", F.col("value").alias("is"))
    return a.join(b, [*by, "key"], "full_outer").filter(F.col("key").isin(allowed)).select(*by, "key", F.coalesce("is", "was").alias("value"))


def action_totals(plan: DataFrame) -> DataFrame:
    """Archives and bytes per planned action."""
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def walk_counts(cached: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: cached paths that still exist, vanished ones, and new ones."""
    a, b = cached.select("rel", F.lit(1).alias("was")), listing.select("rel", F.lit(1).alias("is"))
    both = a.join(b, "rel", "full_outer")
    return both.agg(F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("kept"), F.count_if(F.col("is").isNull()).alias("vanished"), F.count_if(F.col("was").isNull()).alias("new"))


def pose_census(poses: DataFrame) -> DataFrame:
    return poses.groupBy("source", "arbitrated").agg(F.count("*").alias("n"))


def kept_poses(poses: DataFrame) -> DataFrame:
    """What a cleanup keeps: the poses that the arbiter moved."""
    return poses.filter(F.col("source") == "vlm")
