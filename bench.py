"""Times the headline queries and prints one JSON line: BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from braidwork.plans import catalogue

QUERIES = (
    "hybrid_rrf", "bm25_topk", "vector_topk", "top1_per_group", "segment_gap_or_change", "segment_summary", "moving_avg_centered", "central_difference", "peak_row", "band_join_segments", "priority_fill", "coverage_pivot",
    "overlap_windows_avg", "kalman_fill", "text_tokens_df", "sentence_rejoin_ts", "classify_reasons", "chunk_words", "markdown_chunks", "recall_mrr", "threshold_sweep", "standings", "stream_sessions",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = catalogue.queries(), {}
    found["top1_per_group"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's engine
    for name in QUERIES:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
