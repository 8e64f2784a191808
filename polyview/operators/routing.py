"""Incremental runs: what each file still needs, what has retired, how calls went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def route(embedded: Column, pose: Column, sufficient: Column, settled: Column, forced: Column, renders_wanted: Column, renders_complete: Column, skip_embed: Column, pose_changed: Column) -> Column:
    """The next step of a file: decision, needs_embed (of an EmbedRenderTask) and retires (of a CachedHit).

    ``settled`` and ``pose_changed`` are the two flags of a second routing, after this run has decided the pose.
    """
    unposed = ~forced & ~(pose & (settled | sufficient))
    draw = renders_wanted & (pose_changed | ~renders_complete)
    decision = (
        F.when(unposed, "PoseRenderTask")
        .when(~embedded & ~skip_embed, "EmbedRenderTask")
        .when(skip_embed, F.when(draw, "EmbedRenderTask").otherwise("Retired"))
        .otherwise(F.when(draw, "Redraw").otherwise("CachedHit"))
    )
    needs_embed = F.when(decision == "EmbedRenderTask", ~skip_embed)
    return F.struct(decision.alias("decision"), needs_embed.alias("needs_embed"), F.when(decision.isin("CachedHit", "Redraw"), ~draw).alias("retires"))


def outstanding(admitted: DataFrame, retired: DataFrame, parked: DataFrame, skip_embed: bool) -> DataFrame:
    """Admitted files not retired (column id): whether a dead child fails them, and whether they show that it lives."""
    p = parked.select("id").distinct().withColumn("parked", F.lit(True))
    left = admitted.join(retired.select("id"), "id", "left_anti").join(p, "id", "left").withColumn("parked", F.coalesce("parked", F.lit(False)))
    return left.select("id", (~(F.col("parked") & F.lit(skip_embed))).alias("to_fail"), (~F.col("parked")).alias("child_owed"))


def last_row_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])))
    return placed.filter("_n = 1").drop("_n")


def first_retirements(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.filter("_n = 1").drop("_n")


#: Outcomes of a call: what the breaker counts, and what shows that the environment is sound.
COUNTED, HEALTHY = ["unavailable", "failed"], ["answer", "rejected"]


def failure_streaks(log: DataFrame) -> DataFrame:
    """Runs of consecutive failures per user: answers and rejections reset, cancelled calls neither count nor reset."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = log.withColumn("run", F.sum(F.when(F.col("outcome").isin(HEALTHY), 1).otherwise(0)).over(w)).filter(F.col("outcome").isin(COUNTED))
    out = run.groupBy("user_id", "run").agg(F.count("*").alias("failures"), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("span_s"))
    return out.withColumn("tripped", (F.col("failures") >= 5) & (F.col("span_s") >= 60))


def paced_starts(log: DataFrame, spacing: int) -> DataFrame:
    """Start times no closer than ``spacing``: start_i = max over j <= i of (arrival_j - j * spacing) + i * spacing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = log.select("user_id", "event_id", "ts", F.unix_seconds("ts").alias("arrival"), F.row_number().over(w).alias("i"))
    low = F.max(F.col("arrival") - F.col("i") * spacing).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("user_id", "event_id", "arrival", (low + F.col("i") * spacing).alias("start"))


def in_flight(moves: DataFrame) -> DataFrame:
    """Running sum of +1 admissions and -1 retirements."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("in_flight", F.sum("change").over(w))


def resident_bytes(moves: DataFrame, by: str, order: list[str], budget: int) -> DataFrame:
    """Running sum of signed bytes per renderer, and whether it lies over the (soft) budget."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.withColumn("resident", F.sum("bytes").over(so_far)).withColumn("over", F.col("resident") > budget)


#: Statuses that are the environment's and not the request's, and reasons that judge the request.
TRANSIENT_STATUS = [401, 403, 404, 408, 409, 425]
REJECTED_REASONS = ["SAFETY", "BLOCKLIST", "PROHIBITED_CONTENT", "RECITATION", "SPII", "IMAGE_SAFETY"]


def retry_class(status: Column) -> Column:
    """What an HTTP status means for another attempt."""
    return F.when(status.isin(429, 503), "rate_limited").when(status.isin(TRANSIENT_STATUS) | (status >= 500), "transient").when(status >= 400, "rejected").otherwise("ok")


def tile_answer(text: Column, n_tiles: Column) -> Column:
    """The tile from 0 in a reply that holds {"tile": n}, null for any other reply.  A JSON true counts as 1, a string or fraction does not count."""
    body = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    # inside an array, since the parser passes over what follows a whole value; nothing may follow
    listed = F.try_parse_json(F.concat(F.lit("["), F.when(body != "", body), F.lit("]")))
    tile = F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0].tile", "variant"))
    kind = F.schema_of_variant(tile)
    n = F.when(kind == "BIGINT", tile.cast("long")).when(kind == "BOOLEAN", tile.cast("boolean").cast("long"))
    return F.when((n >= 1) & (n <= n_tiles), n - 1)


def call_outcome(status: Column, body: Column) -> Column:
    """answered, rejected, rate_limited or unavailable.  Only a stated verdict rejects: no status, no JSON or no answer is unavailable."""
    parts = F.get_json_object(body, "$.candidates[0].content.parts")
    finish, block = F.get_json_object(body, "$.candidates[0].finishReason"), F.get_json_object(body, "$.promptFeedback.blockReason")
    return (
        F.when(status.isin(429, 503), "rate_limited")
        .when(status.isNull() | status.isin(TRANSIENT_STATUS) | (status >= 500), "unavailable")
        .when(status >= 400, "rejected")
        .when(F.try_parse_json(body).isNull(), "unavailable")
        .when(parts.isNotNull() & (parts != "[]"), "answered")
        .when(block.isNotNull() | F.coalesce(finish.isin(REJECTED_REASONS), F.lit(False)), "rejected")
        .otherwise("unavailable")
    )
