"""Comparisons of whole runs: precisions, backends, probes, arms of a parser, render sizes.  One aggregation each, over rows of any number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions.order import medians, quantiles
from polyview.functions.staging import stage_table

GATE = 0.45


def _sets(pooled: dict[str, list[str]], everything: str | None = None) -> Column:
    """The sets that a row counts for: its own, the pooled ones that hold it, and the one of all rows."""
    names = [F.col("set"), *[F.when(F.col("set").isin(members), F.lit(name)) for name, members in pooled.items()], *([F.lit(everything)] if everything else [])]
    return F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("of")


def precision_report(scores: DataFrame, low: str, base: str, high: str, drift: float) -> DataFrame:
    """Per mode what lower precision changes, from scores (mode, precision, row_id, text_id, score).

    n, top1_flips, top3_set, top3_order (low against base), high_flips (base against high), and of the base's margin between its two best texts:
    least, p1, median, and how many lie below the drift and twice it.  Ties go to the smaller text.
    """
    held = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "text_id")))  # a model's texts
    rows = scores.groupBy("mode", "row_id", "precision").agg(held.alias("o"))
    rows = rows.select("mode", "row_id", "precision", F.transform(F.slice("o", 1, 3), lambda x: x["text_id"]).alias("top"), (F.get("o", F.lit(1))["m"] - F.get("o", F.lit(0))["m"]).alias("margin"))
    of = lambda p, c: F.max(F.when(F.col("precision") == p, F.col(c)))
    both = rows.groupBy("mode", "row_id").agg(of(low, "top").alias("a"), of(base, "top").alias("b"), of(high, "top").alias("c"), of(base, "margin").alias("margin"))
    both = stage_table(both, "margins")
    first = lambda c: F.get(c, F.lit(0))
    counts = {"top1_flips": first("a") != first("b"), "top3_set": F.array_sort("a") != F.array_sort("b"), "top3_order": F.col("a") != F.col("b"), "high_flips": first("b") != first("c"), "below_drift": F.col("margin") < drift, "below_twice": F.col("margin") < 2 * drift}
    out = both.groupBy("mode").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()], F.min("margin").alias("least"))
    return out.join(quantiles(both, "mode", "margin", 0.01).withColumnRenamed("mid", "p1"), "mode").join(medians(both, "mode", "margin").withColumnRenamed("mid", "median"), "mode")


def flip_groups(rows: DataFrame) -> DataFrame:
    """Per group of rows (group, before, after, drift): n, flips, the greatest and the median drift."""
    out = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("flips"), F.max("drift").alias("most"))
    return out.join(medians(rows, "group", "drift").withColumnRenamed("mid", "median"), "group")


def pose_flips(rows: DataFrame, band: float, gate: float = GATE) -> DataFrame:
    """One row for a census (cached, live margins) and a comparison (eager, compiled margins and picks up_a, up_b) of its exposed part.

    Exposed is a live margin within ``band`` of the gate, or at most ``band``; only exposed rows are compared.
    """
    near = lambda m: F.abs(F.col(m) - gate) <= band
    rows = rows.withColumn("moved", F.abs(F.col("live") - F.col("cached"))).withColumn("exposed", near("live") | (F.col("live") <= band)).withColumn("delta", F.when(F.col("exposed"), F.abs(F.col("eager") - F.col("compiled")))).withColumn("one", F.lit(1))
    rows = stage_table(rows, "census")
    compared = lambda c: F.count_if(F.col("exposed") & c)
    counts = {"n": F.count("*"), "in_gate": F.count_if(near("live")), "in_zero": F.count_if(F.col("live") <= band), "compared": F.count_if("exposed"), "gate_flips": compared((F.col("eager") < gate) != (F.col("compiled") < gate)), "up_flips": compared(F.col("up_a") != F.col("up_b")), "still_gate": compared(near("eager")), "still_zero": compared(F.col("eager") <= band), "most_moved": F.max("moved"), "most_delta": F.max("delta")}
    out = rows.groupBy("one").agg(*[c.alias(k) for k, c in counts.items()])
    parts = [medians(rows, "one", "moved").withColumnRenamed("mid", "median_moved"), quantiles(rows, "one", "moved", 0.9).withColumnRenamed("mid", "p90_moved"), medians(rows, "one", "delta").withColumnRenamed("mid", "median_delta")]
    return reduce(lambda a, b: a.join(b, "one", "left"), parts, out).drop("one")


def head_to_head(rows: DataFrame) -> DataFrame:
    """Per size of rows (size, a, b, gold): all of them, those that differ, and of these who is right."""
    differ = F.col("a") != F.col("b")
    a, b = F.count_if(differ & (F.col("a") == F.col("gold"))), F.count_if(differ & (F.col("b") == F.col("gold")))
    out = rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if(differ).alias("differ"), a.alias("a_right"), b.alias("b_right"))
    return out.withColumn("both_wrong", F.col("differ") - F.col("a_right") - F.col("b_right"))


def probe_deltas(rows: DataFrame, base: str, pooled: dict[str, list[str]]) -> DataFrame:
    """Per model, probe and set of rows (model, probe, set, pick, gold): right, n, and right less the base probe's."""
    got = rows.select("*", _sets(pooled)).groupBy("model", "of", "probe").agg(F.count_if(F.col("pick") == F.col("gold")).alias("right"), F.count("*").alias("n"))
    ground = got.filter(F.col("probe") == base).select("model", "of", F.col("right").alias("ground"))
    return got.join(ground, ["model", "of"], "left").select("model", "of", "probe", "right", "n", (F.col("right") - F.col("ground")).alias("delta"))


def arms(rows: DataFrame, gate: float = GATE) -> DataFrame:
    """Two arms over the same models (set, gold, geo_a, geo_b, a, b, m_a, m_b): per set, and for all.

    Right picks of each arm, with and without geometry alone; picks that moved; the mean and greatest shift of the margin; how many escalate, and
    how many cross the gate between the arms.
    """
    shift = F.abs(F.col("m_b") - F.col("m_a"))
    right = {f"{c}_right": F.col(c) == F.col("gold") for c in ("a", "b", "geo_a", "geo_b")}
    low_a, low_b = F.col("m_a") < gate, F.col("m_b") < gate
    counts = right | {"moved": F.col("a") != F.col("b"), "geo_moved": F.col("geo_a") != F.col("geo_b"), "escalates_a": low_a, "escalates_b": low_b, "crossings": low_a != low_b, "lost": low_a & ~low_b}
    return rows.select("*", _sets({}, "all")).groupBy("of").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()], F.avg(shift).alias("mean_shift"), F.max(shift).alias("most_shift"))


def gauntlet(rows: DataFrame, at: int) -> DataFrame:
    """Per method of rows (method, size, stem, pick, gold): right and n at render size ``at``, unanswered ones, and whether all sizes pick alike."""
    by = rows.groupBy("method", "stem").agg((F.count_distinct(F.coalesce("pick", F.lit(-1))) == 1).alias("alike"), F.max(F.when(F.col("size") == at, F.struct("pick", "gold"))).alias("p"))
    p = lambda c: F.col("p")[c]
    return by.groupBy("method").agg(F.count_if(p("pick") == p("gold")).alias("right"), F.count_if(F.col("p").isNotNull()).alias("n"), F.count_if(F.col("p").isNotNull() & p("pick").isNull()).alias("unanswered"), F.bool_and("alike").alias("stable"))
