"""Row numbers over a whole table and exact medians, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.functions.staging import stage_table


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with nth, from 0: ranges of the order are numbered side by side, and the ranges' sizes, one row each, summed."""
    return numbered_within(rows.withColumn("_all", F.lit(0)), "_all", [order]).drop("_all")


def numbered_within(rows: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """``rows`` with nth, from 0 within each ``by``: a large group is spread over ranges of its order.

    The ranges are written once, so that a row's range is the same wherever it is read.  Only a range's first group can go on from an earlier
    range, so the offsets number at most the ranges, and go to all tasks.  Rows that tie in ``order`` have no order between them.
    """
    keys = [F.col(by), *[F.col(c) if isinstance(c, str) else c for c in order]]
    ranged = stage_table(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    bases = sizes.select(by, "_part", F.sum("_n").over(before).alias("_base")).filter("_base IS NOT NULL").select(F.col(by).alias("_by"), F.col("_part").alias("_at"), "_base")
    placed = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*keys[1:])) - 1)
    met = placed.join(F.broadcast(bases), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")), "left")
    return met.withColumn("nth", F.coalesce("_base", F.lit(0)) + F.col("_in")).drop("_part", "_base", "_in", "_by", "_at")


def quantiles(rows: DataFrame, by: str, value: str, share: float, bins: int = 4096) -> DataFrame:
    """``by`` and the exact quantile of ``value`` (nulls aside), as mid; between two values it goes in proportion.

    Counts of bins of width 1 / bins, combined before their shuffle, tell which bins hold the place; only those bins'
    distinct values are then put in order.  A hot key costs its rows in those bins, not all its rows.
    """
    rows = rows.select(by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    # not-a-number sorts last, as in every order of Spark
    rows = rows.withColumn("_bin", F.when(F.isnan("_v"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("_v") * bins)))
    key = Window.partitionBy(by)
    held = rows.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    held = held.withColumn("_to", F.sum("_n").over(key.orderBy("_bin"))).withColumn("_place", (F.sum("_n").over(key) - 1) * F.lit(float(share)))
    held = held.withColumn("_low", F.floor("_place")).withColumn("_high", F.ceil("_place"))
    middle = held.filter("_to > _low and _to - _n <= _high").select(by, "_bin", (F.col("_to") - F.col("_n")).alias("_from"), "_low", "_high", "_place")
    values = rows.join(middle, [by, "_bin"]).groupBy(by, "_v").agg(F.count("*").alias("_n"), F.min("_from").alias("_from"), *[F.first(c).alias(c) for c in ("_low", "_high", "_place")])
    to = F.min("_from").over(key) + F.sum("_n").over(key.orderBy("_v"))
    values = values.withColumn("_to", to)
    at = lambda r: F.max(F.when((F.col(r) < F.col("_to")) & (F.col(r) >= F.col("_to") - F.col("_n")), F.col("_v")))
    found = values.groupBy(by).agg(at("_low").alias("_a"), at("_high").alias("_b"), F.first(F.col("_place") - F.col("_low")).alias("_f"))
    return found.select(by, F.when(F.col("_f") == 0, F.col("_a")).when(F.col("_f") == 0.5, (F.col("_a") + F.col("_b")) / 2).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("mid"))


def medians(rows: DataFrame, by: str, value: str, bins: int = 4096) -> DataFrame:
    """``by`` and the exact median of ``value`` (nulls aside), as mid."""
    return quantiles(rows, by, value, 0.5, bins)
