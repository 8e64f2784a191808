"""Registered queries on meshes: facets written as text from the tables' numbers, parsed again, measured and sampled."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview.operators.surface import sample_points, with_normals
from polyview.plans import fixtures as X
from polyview.plans.registry import add
from polyview.sources.meshes import CORNERS, parse_texts

#: A facet a vector: its first nine numbers, in thousandths; every seventh is a point without area.
_FACETS = "f AS (SELECT vec_id // 50 AS model, vec_id, list_transform(range(1, 10), lambda k: (round(embedding[CASE WHEN vec_id % 7 = 0 THEN (k - 1) % 3 + 1 ELSE k END]::DOUBLE * 1000) / 8)) AS p FROM embeddings)"
_CROSS = f"""{_FACETS},
e AS (SELECT *, p[4] - p[1] AS u1, p[5] - p[2] AS u2, p[6] - p[3] AS u3, p[7] - p[1] AS v1, p[8] - p[2] AS v2, p[9] - p[3] AS v3 FROM f),
c AS (SELECT *, u2 * v3 - u3 * v2 AS cx, u3 * v1 - u1 * v3 AS cy, u1 * v2 - u2 * v1 AS cz FROM e),
n AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS len FROM c)"""


def _texts(s, d):
    """model and an ASCII mesh of its facets, in order of id.  Eighths are exact in 32 bits."""
    number = lambda k: F.round(F.get("embedding", F.when(F.col("vec_id") % 7 == 0, F.lit(k % 3)).otherwise(F.lit(k))).cast("double") * 1000) / 8
    vertex = lambda k: F.concat(F.lit("vertex "), F.concat_ws(" ", *[number(3 * k + i).cast("string") for i in range(3)]), F.lit("\n"))
    facet = F.concat(F.lit("facet normal 0 0 0\nouter loop\n"), *map(vertex, range(3)), F.lit("endloop\nendfacet\n"))
    rows = X.table(s, d, "embeddings").select(F.expr("vec_id div 50").alias("model"), "vec_id", facet.alias("facet"))
    listed = F.array_sort(F.collect_list(F.struct("vec_id", "facet")))  # fifty facets a model
    body = F.concat(F.lit("solid m\n"), F.array_join(F.transform(listed, lambda x: x["facet"]), ""), F.lit("endsolid m\n"))
    return rows.groupBy("model").agg(body.alias("body"))


@add("s09_ascii_normals", f"WITH {_CROSS} SELECT model, row_number() OVER (PARTITION BY model ORDER BY vec_id) AS facet, CASE WHEN len > 0 THEN round(cx / len, 6) ELSE 0 END AS nx, CASE WHEN len > 0 THEN round(cy / len, 6) ELSE 0 END AS ny, CASE WHEN len > 0 THEN round(cz / len, 6) ELSE 0 END AS nz, round(len / 2, 4) AS area FROM n")
def _(s, d):
    """Text meshes to facets, with normals by their corners; a facet without area has none."""
    from pyspark.sql.window import Window

    rows = with_normals(parse_texts(_texts(s, d), "model", "body"))
    place = F.row_number().over(Window.partitionBy("model").orderBy("at"))
    return rows.select("model", place.cast("long").alias("facet"), *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")], F.round("area", 4).alias("area"))


_U = "('0x' || substr(md5('11|' || model || '|' || point || '|{}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@add("x09_surface_points", f"""WITH {_CROSS},
a AS (SELECT *, sum(len / 2) OVER (PARTITION BY model ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS hi, sum(len / 2) OVER (PARTITION BY model) AS total FROM n WHERE len > 0),
b AS (SELECT *, hi - len / 2 AS lo FROM a),
d AS (SELECT model, point::INT AS point, any_value(total) * {_U.format(0)} AS t, {_U.format(1)} AS u, {_U.format(2)} AS v FROM a, range(40) AS r(point) GROUP BY model, point),
k AS (SELECT d.*, b.* EXCLUDE (model) FROM d JOIN b ON b.model = d.model AND t >= lo AND t < hi)
SELECT model, point, round((1 - sqrt(u)) * p[1] + sqrt(u) * (1 - v) * p[4] + sqrt(u) * v * p[7], 4) AS x, round((1 - sqrt(u)) * p[2] + sqrt(u) * (1 - v) * p[5] + sqrt(u) * v * p[8], 4) AS y,
  round((1 - sqrt(u)) * p[3] + sqrt(u) * (1 - v) * p[6] + sqrt(u) * v * p[9], 4) AS z, round(cz / len, 5) AS nz FROM k""")
def _(s, d):
    """Forty points a model, drawn by area with a seed."""
    facets = parse_texts(_texts(s, d), "model", "body").select("model", "at", *CORNERS)
    points = sample_points(facets, 40, seed=11, by="model")
    return points.select("model", "point", *[F.round(c, 4).alias(c) for c in "xyz"], F.round("nz", 5).alias("nz"))
