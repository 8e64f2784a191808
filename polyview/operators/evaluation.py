"""Accuracy, flips, margins and cost of predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.functions.order import numbered_within


def accuracy(predictions: DataFrame, pooled: dict[str, list[str]]) -> DataFrame:
    """k of n right per method and set, with pooled sets that overlap the plain ones."""
    names = F.array(F.col("set"), *[F.when(F.col("set").isin(members), F.lit(name)) for name, members in pooled.items()])
    rows = predictions.filter("pick is not null").withColumn("of", F.explode(F.filter(names, lambda x: x.isNotNull())))
    return rows.groupBy("method", "of").agg(F.count_if(F.col("pick") == F.col("gold")).alias("right"), F.count("*").alias("n"))


def verdict(before: Column, after: Column, gold: Column) -> Column:
    return F.when((before == gold) & (after == gold), "right").when(after == gold, "fixed").when(before == gold, "broken").when(before == after, "wrong").otherwise("wrong->wrong")


def rescue(rows: DataFrame, gate: float) -> DataFrame:
    """What an arbiter does behind a margin gate: fired, rescued, broke, net, right in all (per set)."""
    fired = F.col("margin") < gate
    pick = F.when(fired, F.col("arbiter")).otherwise(F.col("ensemble"))
    right = F.col("ensemble") == F.col("gold")
    good = F.col("arbiter") == F.col("gold")
    return rows.groupBy("set").agg(F.count_if(fired).alias("fired"), F.count_if(fired & ~right & good).alias("rescued"), F.count_if(fired & right & ~good).alias("broke"), F.count_if(pick == F.col("gold")).alias("right"), F.count("*").alias("n")).withColumn("net", F.col("rescued") - F.col("broke"))


def margin_quantiles(rows: DataFrame, by: str, margin: str = "margin") -> DataFrame:
    q = F.percentile(margin, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(by).agg(q.alias("q"), F.count("*").alias("n")).select(by, *[F.element_at("q", k + 1).alias(f"q{25 * (k + 1)}") for k in range(3)], "n")


def token_cost(tokens_in: Column, thinking: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + (thinking + tokens_out) * price_out) / 1e6


def image_delta(a: Column, b: Column) -> dict[str, Column]:
    """Largest absolute difference of two pixel arrays, number and share of places that differ."""
    steps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    differing = F.size(F.filter(steps, lambda x: x > 0))
    return {"max_delta": F.array_max(steps), "n_differing": differing, "share": differing / F.size(steps)}


def config_accuracy(answers: DataFrame) -> DataFrame:
    """answers (stem, config, pick or null, gold): right, unanswered and all stems per config."""
    return answers.groupBy("config").agg(F.count_if(F.col("pick") == F.col("gold")).alias("right"), F.count_if(F.col("pick").isNull()).alias("unanswered"), F.count("*").alias("n"))


def disagreeing(answers: DataFrame) -> DataFrame:
    """stem, disagree: whether its configs answer differently; no answer counts as an answer of its own."""
    return answers.groupBy("stem").agg((F.count_distinct(F.coalesce("pick", F.lit(-1))) > 1).alias("disagree"))


def changed_answers(answers: DataFrame, base: str) -> DataFrame:
    """(config, stem, before, after) where a config's answer differs from the base config's."""
    before = answers.filter(F.col("config") == base).select("stem", F.col("pick").alias("before"))
    after = answers.filter(F.col("config") != base).select("stem", "config", F.col("pick").alias("after"))
    return after.join(before, "stem").filter(~F.col("before").eqNullSafe(F.col("after"))).select("config", "stem", "before", "after")


def sweep_noise(points: DataFrame) -> DataFrame:
    """One row for points (batch, seconds), one per repetition: spread of the median rates, median jitter, and whether the spread is noise."""
    by_batch = points.groupBy("batch").agg(F.median("seconds").alias("mid"), ((F.max("seconds") - F.min("seconds")) / F.median("seconds")).alias("jitter"))
    rates = by_batch.select("jitter", (F.col("batch") / F.col("mid")).alias("rate"))
    out = rates.agg(((F.max("rate") - F.min("rate")) / F.median("rate")).alias("spread"), F.median("jitter").alias("jitter"))
    return out.withColumn("flat", F.col("spread") <= 2 * F.col("jitter"))


def every_kth(files: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """A fixed sample of each collection: every (n div k)-th file in order, k at most; all of them where there are fewer."""
    steps = files.groupBy(by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / k)).alias("_step")).withColumnRenamed(by, "_of")
    placed = numbered_within(files, by, [order]).join(steps, F.col(by).eqNullSafe(F.col("_of")))
    return placed.filter((F.col("nth") % F.col("_step") == 0) & (F.col("nth") < F.col("_step") * k)).drop("nth", "_step", "_of")


def geometry_grid(candidates: DataFrame, gold: DataFrame, floors: list[float], powers: list[float], gate: float = 0.45) -> DataFrame:
    """How an ensemble that trusts geometry by min(1, best / floor) ** power does over a grid: a row for each floor, power and set.

    ``candidates``: model, candidate, geo, sig; ``gold``: model, gold, set.  n, right, escalates (margin below the gate), moved (another answer than the
    base cell's, power 0, which always trusts geometry), fixed and broke.  A model's candidates meet once in one row, all cells are worked out on that row, and
    counts are combined before their shuffle: no pass for each cell.  The margin is put on the base's scale; ties go to the smaller candidate.
    """
    held = F.array_sort(F.collect_list(F.struct("candidate", F.col("geo").cast("double").alias("geo"), F.col("sig").cast("double").alias("sig"))))
    rows = candidates.groupBy("model").agg(held.alias("c"))  # a row for each of six candidates
    low = lambda k: F.array_min(F.transform("c", lambda x: x[k]))
    high = lambda k: F.array_max(F.transform("c", lambda x: x[k]))
    for k in ("geo", "sig"):
        rows = rows.withColumn(f"{k}_low", low(k)).withColumn(f"{k}_high", high(k))
    unit = lambda x, k: F.when(F.col(f"{k}_high") > F.col(f"{k}_low"), (x[k] - F.col(f"{k}_low")) / (F.col(f"{k}_high") - F.col(f"{k}_low"))).otherwise(0.0)
    rows = rows.select("model", F.transform("c", lambda x: F.struct(x["candidate"].alias("candidate"), unit(x, "geo").alias("g"), unit(x, "sig").alias("s"))).alias("c"), F.greatest("geo_high", F.lit(0.0)).alias("best"))

    def answer(weight: Column) -> Column:
        # the least of (minus score, candidate) is the winner; the second least gives the margin
        order = F.array_sort(F.transform("c", lambda x: F.struct((-(weight * x["g"] + x["s"])).alias("m"), x["candidate"].alias("candidate"))))
        margin = (F.get(order, F.lit(1))["m"] - F.get(order, F.lit(0))["m"]) * 2 / (1 + weight)
        return F.struct(F.get(order, F.lit(0))["candidate"].alias("pick"), margin.alias("margin"))

    cells = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.lit(float(p)).alias("power")) for f in floors for p in powers]))
    rows = rows.withColumn("base", answer(F.lit(1.0))["pick"]).select("*", cells.alias("cell")).select("*", "cell.floor", "cell.power")
    weight = F.when(F.col("power") == 0, 1.0).otherwise(F.pow(F.least(F.lit(1.0), F.col("best") / F.col("floor")), F.col("power")))
    rows = rows.withColumn("w", weight).withColumn("a", answer(F.col("w"))).select("model", "floor", "power", "base", "a.pick", "a.margin")
    met = rows.join(gold.select("model", "gold", "set"), "model")
    moved = F.col("pick") != F.col("base")
    counts = {"right": F.col("pick") == F.col("gold"), "escalates": F.col("margin") < gate, "moved": moved, "fixed": moved & (F.col("pick") == F.col("gold")), "broke": moved & (F.col("base") == F.col("gold"))}
    return met.groupBy("floor", "power", "set").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
