"""Choosing a model's upright orientation: evidence, ensemble, gate, camera angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARGIN_GATE = 0.45
FLOOR, POWER = 0.02, 2.0


def unit(column: str, by: str) -> Column:
    """Min-max within a model; all equal gives 0."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)


def ensemble(candidates: DataFrame) -> DataFrame:
    """model, candidate, geo, sig to the winner (smallest candidate on ties), its score and the margin to the second.

    Geometry counts by how strong its best evidence is: (best / floor) ** power, at most 1.
    """
    w = Window.partitionBy("model")
    weight = F.pow(F.least(F.lit(1.0), F.max("geo").over(w) / FLOOR), POWER)
    scored = candidates.select("model", "candidate", (weight * unit("geo", "model") + unit("sig", "model")).alias("score"))
    ordered = Window.partitionBy("model").orderBy(F.desc("score"), "candidate")
    placed = scored.withColumn("n", F.row_number().over(ordered)).withColumn("next", F.lead("score").over(ordered))
    return placed.filter("n = 1").select("model", F.col("candidate").alias("up"), "score", (F.col("score") - F.col("next")).alias("margin"))


def rank_up(scores: DataFrame) -> DataFrame:
    """Winner, runner-up ratio (1 if the best is not positive; lower is surer) and best; ties to the larger candidate."""
    ordered = Window.partitionBy("model").orderBy(F.desc("score"), F.desc("candidate"))
    placed = scores.withColumn("n", F.row_number().over(ordered)).withColumn("next", F.lead("score").over(ordered)).filter("n = 1")
    return placed.select("model", F.col("candidate").alias("up"), F.when(F.col("score") > 0, F.col("next") / F.col("score")).otherwise(1.0).alias("ratio"), F.col("score").alias("best"))


def needs_arbiter(margin: Column, gate: float = MARGIN_GATE) -> Column:
    return margin < gate


def sufficient(source: Column, arbitrated: Column, margin: Column, available: Column) -> Column:
    """Whether a cached pose needs no more work.  ``arbitrated`` has the texts true, false, rejected or null."""
    return (
        F.when(source.isNull(), False)
        .when(source == "vlm", True)
        .when(arbitrated.isin("true", "rejected"), margin.isNotNull())
        .when(margin.isNull(), False)
        .otherwise(~(available & needs_arbiter(margin)))
    )


def valid_up(up: Column) -> Column:
    return F.coalesce((F.size(up) == 3) & F.forall(up, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(up, lambda x: x != 0), F.lit(False))


def geometry_evidence(points: DataFrame, slab: float = 0.02, facing: float = -0.9) -> DataFrame:
    """Per model and candidate up-vector: share of points in the lowest slab whose normals face down."""
    ups = points.sparkSession.createDataFrame([(0, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 0.0, 0.0, -1.0)], "candidate int, ux double, uy double, uz double")
    high = points.crossJoin(F.broadcast(ups)).withColumn("h", F.expr("x * ux + y * uy + z * uz")).withColumn("f", F.expr("nx * ux + ny * uy + nz * uz"))
    span = high.groupBy("model", "candidate").agg(F.min("h").alias("low"), F.max("h").alias("top"))
    inside = (F.col("h") < F.col("low") + slab * (F.col("top") - F.col("low"))) & (F.col("f") < facing)
    return high.join(span, ["model", "candidate"]).groupBy("model", "candidate").agg(F.when(F.max(F.col("top") - F.col("low")) > 0, F.avg(inside.cast("double"))).otherwise(0.0).alias("geo"))


def view_angles(n: int, elevations: Column) -> Column:
    """(azimuth, elevation) in radians, elevation by elevation."""
    return F.flatten(F.transform(elevations, lambda e: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((2 * F.pi() * i / n).alias("azimuth"), F.radians(e).alias("elevation")))))


def rotation_to_z(up: Column) -> Column:
    """Row-major rotation that turns an up-vector onto z; axis-aligned ones are exact, others by Rodrigues' formula."""
    n = F.sqrt(F.aggregate(up, F.lit(0.0), lambda s, x: s + x * x))
    x, y, z = (F.element_at(up, k) / n for k in (1, 2, 3))
    down = z < -1 + 1e-12
    k = 1 / (1 + z)
    plain = F.array(1 - x * x * k, -x * y * k, -x, -x * y * k, 1 - y * y * k, -y, x, y, z)
    flip = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)])
    return F.when(down, flip).otherwise(plain)
