"""Times the headline queries: one JSON line. Folder in BENCH_SF_DIR, cores in BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewell import catalogue

HEADLINE = (
    "status_counts", "sample_page", "user_page_counts", "event_facets", "nested_failed_items", "newest_per_owner", "best_attempt",
    "priority_dedupe", "eval_leak_exact", "eval_leak_containment", "training_mix", "lexical_topk", "bm25_topk", "vector_topk", "chat_context",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
