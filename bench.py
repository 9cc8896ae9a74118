"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

QUERIES = ("log_count_by_level", "log_count_sliding", "json_filter", "logfmt_filter", "unwrap_avg", "raw_logs_limit", "bucket_sum", "rate_range", "sparse_range", "binop_on", "topk_per_step", "histogram_quantile", "summary_percentiles", "rollup_chain", "log_agg_10s", "tag_values", "fingerprint_prune", "stream_rollup")


def main() -> None:
    from pyspark.sql import SparkSession

    from tellurion import catalog

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    found["bucket_sum"](spark, folder).count()  # the first query also starts the JVM's compiler
    for name in QUERIES:
        start = time.perf_counter()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
