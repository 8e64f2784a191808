"""Vector arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: str | Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / norm)


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean by key, L2-normalised; partial sums meet in the shuffle, not vectors."""
    means = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    ordered = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("m"))
    return ordered.select(key, l2_normalise("m").alias(vector))


def register(spark) -> None:
    """SQL functions: dot(a, b) and l2(v) for use in spark.sql."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))")
