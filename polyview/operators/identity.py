"""Names, paths and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that mark a file as a variant, after "not supported" spellings are removed.
TAGS = ["presupported", "pre-supported", "pre_supported", "supported", "lychee", "chitubox", "base", "hollow", "75mm"]
UNSUPPORTED = "(?<![a-z])(?:un|no[nt]?)[\\s_-]*support(?:ed|s)?"


def skipped(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), UNSUPPORTED, "")
    return F.array_max(F.array(*[F.contains(bare, F.lit(t)).cast("int") for t in TAGS])) == 1


def walked(name: Column) -> Column:
    return ~name.startswith(".") & F.lower(name).endswith(".stl")


def display_name(rel: Column) -> Column:
    return F.regexp_replace(F.replace(rel, F.lit("/No Supports"), F.lit("")), "\\.stl$", "")


def file_identity(rel: Column, mtime_ns: Column, size: Column) -> Column:
    """Relative path, whole seconds (rounded down, in whole numbers: a double would round the last nanosecond up) and size."""
    ns = mtime_ns.cast("long")
    seconds = ((ns - F.pmod(ns, F.lit(1_000_000_000))).cast("decimal(20,0)") / 1_000_000_000).cast("long")
    return F.concat_ws("|", rel, seconds.cast("string"), size.cast("string"))


def embed_key(identity: Column, n_views: int, size: int, up: Column, model: str, elevations: str = "20", compiled: bool = False, version: int | None = None) -> Column:
    """sha1 of the identity and configuration; the default elevations are left out, so that old keys stay."""
    tokens = [identity, F.lit(str(n_views)), F.lit(str(size)), up, F.lit(model), F.lit("pv")]
    tokens += [F.lit(f"e:{elevations}")] if elevations != "20" else []
    tokens += [F.lit("compiled")] if compiled else []
    tokens += [F.lit(f"ev{version}")] if version is not None else []
    return F.sha1(F.concat_ws("|", *tokens).cast("binary"))


def render_key(rel: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(rel, "/"), -1), "\\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.sha1(rel.cast("binary")), 1, 6))


def relative(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def escapes(entry: Column) -> Column:
    return entry.startswith("/") | F.array_contains(F.split(entry, "/"), "..")


def general_number(v: Column) -> Column:
    """Six significant digits without trailing zeros, in scientific form below 1e-4 and from 1e6 on."""
    text = F.format_string("%.5e", v.cast("double"))
    exponent = F.substring_index(text, "e", -1).cast("int")
    fixed = F.regexp_replace(text.cast("decimal(20,10)").cast("string"), "\\.?0+$", "")
    plain = F.when(v == 0, F.when(text.startswith("-"), "-0").otherwise("0")).when(fixed.contains("."), fixed).otherwise(F.regexp_replace(text.cast("decimal(20,10)").cast("long").cast("string"), "^$", "0"))
    mantissa = F.regexp_replace(F.substring_index(text, "e", 1), "\\.?0+$", "")
    return F.when((v == 0) | exponent.between(-4, 5), plain).otherwise(F.concat(mantissa, F.lit("e"), F.substring_index(text, "e", -1)))


def number_list(values: Column) -> Column:
    return F.array_join(F.transform(values, general_number), ",")


def view_config(n_views: Column, elevations: Column) -> Column:
    return F.concat(n_views.cast("string"), F.lit("v-e"), number_list(elevations))


def render_folder(size: Column, n_views: Column, elevations: Column) -> Column:
    return F.concat(size.cast("string"), F.lit("px-"), view_config(n_views, elevations))


def up_token(up: Column, axis: Column) -> Column:
    """The up vector of a usable pose; else that of a forced axis; else 'unresolved'."""
    usable = (F.size(up) == 3) & F.forall(up, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(up, lambda x: x != 0)
    return F.when(F.coalesce(usable, F.lit(False)), number_list(up)).when(axis == "z", "0,0,1").when(axis == "y", "0,1,0").otherwise("unresolved")


def root_note(root: Column, recorded: Column, loose_file: Column) -> Column:
    """How an input lies to the recorded root: struct(root to key against, note)."""
    def below(inner: Column, outer: Column) -> Column:
        return inner.startswith(F.concat(outer, F.lit("/")))

    note = F.when(recorded.isNull() | (root == recorded) | loose_file, F.lit(None)).when(below(root, recorded), "subdir").when(below(recorded, root), "superdir").otherwise("mismatch")
    keep = recorded.isNotNull() & (loose_file | below(root, recorded))
    return F.struct(F.when(keep, recorded).otherwise(root).alias("root"), note.alias("note"))
