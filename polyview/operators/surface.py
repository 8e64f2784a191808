"""Facets of meshes: normals and areas, extents, and points drawn evenly from the surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a file whose facets are searched together.
BLOCK = 1 << 20


def with_normals(facets: DataFrame) -> DataFrame:
    """Facets with unit normal nx, ny, nz by the order of their corners, and area; a facet without area has a normal of zeros."""
    u, v = ([F.col(f"{c}{k}") - F.col(f"{c}1") for c in "xyz"] for k in (2, 3))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    rows = facets.select("*", *[x.alias(f"_c{k}") for k, x in enumerate(cross)])
    rows = rows.withColumn("_n", F.sqrt(sum(F.col(f"_c{k}") * F.col(f"_c{k}") for k in range(3))))
    unit = [F.when(F.col("_n") > 0, F.col(f"_c{k}") / F.col("_n")).otherwise(0.0).alias(f"n{c}") for k, c in enumerate("xyz")]
    return rows.select(*facets.columns, *unit, (F.col("_n") / 2).alias("area"))


def extents(facets: DataFrame, by: str = "path") -> DataFrame:
    """n_facets, area, and the box of each mesh."""
    low = [F.min(F.least(*[F.col(f"{c}{k}") for k in (1, 2, 3)])).alias(f"{c}_low") for c in "xyz"]
    high = [F.max(F.greatest(*[F.col(f"{c}{k}") for k in (1, 2, 3)])).alias(f"{c}_high") for c in "xyz"]
    return with_normals(facets).groupBy(by).agg(F.count("*").alias("n_facets"), F.sum("area").alias("area"), *low, *high)


def _draw(seed: int, mesh: Column, j: Column, k: int) -> Column:
    """A number in [0, 1) of 52 bits, the same for a seed, mesh, point and use."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), mesh.cast("string"), j.cast("string"), F.lit(k))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_points(facets: DataFrame, n: int, seed: int = 0, by: str = "path", order: str = "at") -> DataFrame:
    """by, point (0 to n - 1), x, y, z, nx, ny, nz: points drawn evenly from each mesh's surface, with their facet's normal.

    A draw picks a share of the mesh's area.  Areas are summed in order, inside blocks of a file's bytes and then over blocks, so a long mesh is split
    and a seed gives the same points whatever the tasks.  The block of a draw is found from the blocks' sums, its facet from the sums inside.
    A mesh without area gives no points.
    """
    near = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = with_normals(facets).filter("area > 0").withColumn("_block", F.expr(f"{order} div {BLOCK}"))
    rows = rows.withColumn("_to", F.sum("area").over(near))
    far = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(by, "_block").agg(F.max("_to").alias("_area")).withColumn("_end", F.sum("_area").over(far))
    meshes = blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_block", "_end", "_area"))).alias("_blocks"))
    drawn = meshes.select(by, F.col("_blocks"), F.element_at("_blocks", -1)["_end"].alias("_total"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(j.alias("point"), _draw(seed, F.col(by), j, 0).alias("u"))).alias("_draws"))
    place = lambda d: F.least(F.size(F.filter("_blocks", lambda b: b["_end"] <= d["u"] * F.col("_total"))), F.size("_blocks") - 1)
    found = drawn.select(by, F.explode(F.transform("_draws", lambda d: F.struct(d["point"].alias("point"), (d["u"] * F.col("_total")).alias("t"), F.get("_blocks", place(d)).alias("b")))).alias("d"))
    asked = found.select(F.col(by).alias("_mesh"), F.col("d.b._block").alias("_at"), F.col("d.point").alias("point"), (F.col("d.t") - (F.col("d.b._end") - F.col("d.b._area"))).alias("_t"))
    asked = asked.withColumn("_u", _draw(seed, F.col("_mesh"), F.col("point"), 1)).withColumn("_v", _draw(seed, F.col("_mesh"), F.col("point"), 2))

    def pick(key: tuple, draws: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(draws) or not len(held):
            return pd.DataFrame({c: [] for c in (by, "point", "x", "y", "z", "nx", "ny", "nz")})
        held = held.sort_values(order, ignore_index=True)
        at = np.minimum(np.searchsorted(held["_to"], draws["_t"], side="right"), len(held) - 1)
        r, v = np.sqrt(draws["_u"].to_numpy()), draws["_v"].to_numpy()
        out = {by: [key[0]] * len(draws), "point": draws["point"].to_numpy()}
        for c in "xyz":
            a, b, d = (held[f"{c}{k}"].to_numpy()[at] for k in (1, 2, 3))
            out[c] = (1 - r) * a + r * (1 - v) * b + r * v * d
        return pd.DataFrame(out | {f"n{c}": held[f"n{c}"].to_numpy()[at] for c in "xyz"})

    kind = facets.select(by).schema[0].dataType.simpleString()
    schema = f"{by} {kind}, point int, x double, y double, z double, nx double, ny double, nz double"
    return asked.groupBy("_mesh", "_at").cogroup(rows.groupBy(by, "_block")).applyInPandas(pick, schema)
