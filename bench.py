"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from polyview.plans.registry import QUERIES

NAMES = ["p03_pool_softmax_query", "p01_pool_mean", "j05_j06_l03_similar", "w04_top3", "a12_n18_n19_ensemble", "j14_u01_tree_compare", "n26_n27_f12_zip_plan", "w13_r07_breaker", "f01_names"]


def main() -> None:
    cpus, data = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in NAMES:
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()  # warm
        began = time.time()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": data.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
