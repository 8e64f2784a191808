"""Camera positions and framing of meshes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounding_box(vertices: DataFrame, by: str) -> DataFrame:
    """Centre, extent and framing radius (1.4 diagonals) of vertices (by, x, y, z)."""
    axes = ("x", "y", "z")
    box = vertices.groupBy(by).agg(*[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("low", F.min), ("high", F.max))])
    extent = {a: F.col(f"{a}_high") - F.col(f"{a}_low") for a in axes}
    centre = [((F.col(f"{a}_high") + F.col(f"{a}_low")) / 2).alias(f"centre_{a}") for a in axes]
    return box.select(by, *centre, *[e.alias(f"extent_{a}") for a, e in extent.items()], (F.sqrt(sum(e * e for e in extent.values())) * 1.4).alias("radius"))


def orbit_camera(centre: tuple[Column, Column, Column], radius: Column, azimuth: Column, elevation: Column) -> dict[str, Column]:
    """Eye, camera up (carried along the orbit) and light direction (from the camera, tilted down by 0.6)."""
    ahead = (F.cos(azimuth) * F.cos(elevation), F.sin(azimuth) * F.cos(elevation), F.sin(elevation))
    up = (-F.cos(azimuth) * F.sin(elevation), -F.sin(azimuth) * F.sin(elevation), F.cos(elevation))
    light = (-ahead[0], -ahead[1], -ahead[2] - 0.6)
    length = F.sqrt(sum(c * c for c in light))
    out: dict[str, Column] = {}
    for k, axis in enumerate("xyz"):
        out |= {f"eye_{axis}": centre[k] + radius * ahead[k], f"up_{axis}": up[k], f"light_{axis}": light[k] / length}
    return out
