"""K-means over mean view vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.functions.order import numbered_within
from polyview.functions.staging import stage_table
from polyview.functions.vectors import mean_vectors


def clusters(views: DataFrame, k: int, seeds: int = 10) -> DataFrame:
    """row_id, cluster (by size, largest first), its size, distance to the centroid and place by distance, of the cheapest of ``seeds`` fits."""
    means = stage_table(mean_vectors(views, "row_id"), "means")  # read by every iteration of every fit
    data = means.select("row_id", array_to_vector("embedding").alias("features"))
    fits = [KMeans(k=k, seed=n, maxIter=20).fit(data) for n in range(seeds)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in best.clusterCenters()])
    placed = best.transform(data).withColumn("c", F.element_at(centres, F.col("prediction") + 1))
    near = placed.select("row_id", "prediction", F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("distance"))
    sizes = near.groupBy("prediction").agg(F.count("*").alias("size")).withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "prediction")) - 1)
    members = near.join(F.broadcast(sizes), "prediction").select("row_id", "cluster", "size", "distance")
    return numbered_within(members, "cluster", ["distance", "row_id"]).select("row_id", "cluster", "size", F.round("distance", 4).alias("distance"), (F.col("nth") + 1).cast("int").alias("place"))
