"""A versioned table by key that streams add to while other queries read it.

Layout below ``base``: ``delta/<n>/`` and ``whole/<n>/`` hold rows, ``commits/<n>.json`` names what version n is made of.  A version exists when
its commit file does; that file is created once, by name, so of two writers one wins and the other takes the next number.  Numbers, not
clocks, order versions.  Rows of a later version replace those of an earlier one by key, and a row with ``removed`` takes its key away.

A micro-batch is known by its stream's name and its id: after a restart the engine may run the last batch again, and a batch that is committed is not
added a second time.  A batch that was torn before its commit leaves a folder that no version names; ``sweep`` deletes those.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from polyview.functions.commits import Commits


class LiveStore:
    """Rows of ``schema`` by ``key`` below ``base``; ``order`` decides between rows of one batch (the greatest stays)."""

    def __init__(self, spark: SparkSession, base: str, schema: str, key: str, order: str):
        self.spark, self.base, self.key, self.order = spark, base.rstrip("/"), key, order
        self.columns = StructType.fromDDL(schema).fieldNames()
        self.schema = StructType.fromDDL(f"{schema}, removed boolean, version long")
        self.log = Commits(spark, base)

    def commits(self) -> list[dict]:
        """Every commit in order of version: one small file each."""
        return self.log.entries()

    def _commit(self, kind: str, place: str, **more) -> int:
        return self.log.add({"kind": kind, "place": place, **more})

    def upsert(self, rows: DataFrame, stream: str, batch_id: int) -> int | None:
        """Add the rows of a batch as the next version; None if that batch is there already."""
        if any((c.get("stream"), c.get("batch")) == (stream, batch_id) for c in self.commits()):
            return None
        if "removed" not in rows.columns:
            rows = rows.withColumn("removed", F.lit(False))
        place = f"delta/{uuid.uuid4().hex}"
        last = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*self.columns, "removed"), F.struct(self.order, "removed", F.xxhash64(*self.columns))).alias("r"))
        last.select("r.*").write.parquet(f"{self.base}/{place}")
        return self._commit("delta", place, stream=stream, batch=batch_id)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows in force at ``version`` (by default the newest); an empty table before the first."""
        commits = [c for c in self.commits() if version is None or c["version"] <= version]
        start = max((k for k, c in enumerate(commits) if c["kind"] == "whole"), default=0)
        parts = [self.spark.read.schema(StructType(self.schema.fields[:-1])).parquet(f"{self.base}/{c['place']}").withColumn("version", F.lit(c.get("through", c["version"])).cast("long")) for c in commits[start:]]
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1:  # one row a key in each part
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.columns, "removed"), "version").alias("r")).select("r.*")
        return rows.filter("NOT removed").select(*self.columns)

    def compact(self) -> int | None:
        """Write the newest version as one whole table, so that readers start from it; batches stay known by their commits."""
        commits = self.commits()
        if not commits or commits[-1]["kind"] == "whole":
            return None
        through, place = commits[-1]["version"], f"whole/{uuid.uuid4().hex}"
        self.read(through).withColumn("removed", F.lit(False)).write.parquet(f"{self.base}/{place}")
        if self.commits()[-1]["version"] != through:  # a batch came meanwhile: a whole table numbered after it would hide it
            self.log.delete(place)
            return None
        return self._commit("whole", place, through=through)

    def sweep(self) -> int:
        """Delete folders that no commit names: torn batches.  Only while nothing writes."""
        named = {c["place"] for c in self.commits()}
        torn = [f"{kind}/{n}" for kind in ("delta", "whole") for n in self.log.names(kind) if f"{kind}/{n}" not in named]
        for place in torn:
            self.log.delete(place)
        return len(torn)

    def sink(self, rows: DataFrame, stream: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
        """A stream's writer into the store.  ``then`` gets the batch and its id after the commit, and must itself bear being run again."""

        def add(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, stream, batch_id)
            if then:
                then(batch, batch_id)

        return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def routed_stream(files: DataFrame, store: LiveStore, decide: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Decisions on a stream of files, each micro-batch against the newest version, so that later files see this run's results.

    ``decide`` gets the batch and the store's rows.  A batch that runs again overwrites its own folder.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        decide(batch, store.read()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
