"""How the driver's tables stand in for a collection: models of four views, texts, paths, pose grids, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.functions.vectors import mean_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 4").alias("row_id"), (F.col("vec_id") % 4).cast("int").alias("view"), F.col("embedding").cast("array<double>").alias("embedding"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("text_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return mean_vectors(e, "text_id")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, rel; every fifth id beyond the embedded ones is scanned but not indexed."""
    r = views(spark, sf_dir).select("row_id").distinct().withColumn("indexed", F.lit(True))
    extra = r.filter("row_id % 5 = 0").select((F.col("row_id") + 100000).alias("row_id"), F.lit(False).alias("indexed"))
    return r.union(extra).withColumn("rel", F.concat(F.lit("kit"), (F.col("row_id") % 7).cast("string"), F.lit("/m"), F.col("row_id").cast("string"), F.lit(".stl")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ["_NoSupports", "_Supported", " - Unsupported", "_LYCHEE", "_Base", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix).alias("name"), F.col("p_size").cast("long").alias("size"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline log from events: errors are unavailable calls, views failed ones, some purchases answers, some signups rejections, the rest cancelled."""
    outcome = F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") == "view", "failed").when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "answer").when((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0), "rejected").otherwise("cancelled")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"), "value")


def pose_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, candidate, az, score: two azimuths of six orientation candidates; incomplete models are left out."""
    e = table(spark, sf_dir, "embeddings")
    grid = e.select(F.expr("vec_id div 12").alias("model"), F.expr("cast((vec_id div 2) % 6 as int)").alias("candidate"), (F.col("vec_id") % 2).cast("int").alias("az"), F.element_at("embedding", 1).cast("double").alias("score"))
    full = grid.groupBy("model").count().filter("count = 12").select("model")
    return grid.join(full, "model", "left_semi")


#: The same definitions in SQL, for the oracles.
SQL = {
    "views": "views AS (SELECT vec_id // 4 AS row_id, (vec_id % 4)::INT AS view, embedding::DOUBLE[] AS e FROM embeddings)",
    "texts": "tm AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY ALL), tn AS (SELECT label, sqrt(sum(x * x)) AS n FROM tm GROUP BY 1), texts AS (SELECT tm.label AS text_id, list(x / n ORDER BY i) AS t FROM tm JOIN tn ON tm.label = tn.label GROUP BY 1)",
    "sims": "sims AS (SELECT row_id, view, text_id, list_dot_product(e, t) AS sim FROM views, texts)",
    "soft": "mx AS (SELECT row_id, text_id, max(sim) AS m FROM sims GROUP BY ALL), pooled AS (SELECT s.row_id, s.text_id, sum(exp(50 * (sim - m)) * sim) / sum(exp(50 * (sim - m))) AS score FROM sims s JOIN mx ON s.row_id = mx.row_id AND s.text_id = mx.text_id GROUP BY ALL)",
    "z": "md AS (SELECT text_id, median(score) AS m FROM pooled GROUP BY 1), mad AS (SELECT p.text_id, median(abs(score - m)) * 1.4826 + 1e-9 AS s FROM pooled p JOIN md ON p.text_id = md.text_id GROUP BY 1), scored AS (SELECT row_id, p.text_id, score, (score - m) / s AS z, row_number() OVER (PARTITION BY p.text_id ORDER BY score DESC, row_id) AS rank FROM pooled p JOIN md ON p.text_id = md.text_id JOIN mad ON p.text_id = mad.text_id)",
    "models": "mi AS (SELECT DISTINCT row_id, true AS indexed FROM views), models AS (SELECT *, 'kit' || (row_id % 7) || '/m' || row_id || '.stl' AS rel FROM (SELECT * FROM mi UNION ALL SELECT row_id + 100000, false FROM mi WHERE row_id % 5 = 0))",
    "names": "names AS (SELECT p_partkey, replace(p_name, ' ', '_') || ['_NoSupports', '_Supported', ' - Unsupported', '_LYCHEE', '_Base', ''][p_partkey % 6 + 1] AS name, p_size::BIGINT AS size FROM part)",
    "log": "log AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN event_type = 'view' THEN 'failed' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'answer' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'rejected' ELSE 'cancelled' END AS outcome, value FROM events)",
    "grid": "g0 AS (SELECT vec_id // 12 AS model, ((vec_id // 2) % 6)::INT AS candidate, (vec_id % 2)::INT AS az, embedding[1]::DOUBLE AS score FROM embeddings), grid AS (SELECT * FROM g0 WHERE model IN (SELECT model FROM g0 GROUP BY 1 HAVING count(*) = 12))",
}


def ctes(*parts: str) -> str:
    return "WITH " + ", ".join(SQL[p] for p in parts)
