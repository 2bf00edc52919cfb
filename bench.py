"""Times the registered queries and prints one JSON line.

    python bench.py            headline queries, median of three runs after a warm-up
    python bench.py all        every registered query, one run after a warm-up
    python bench.py NAME ...   the named queries

Results go to the noop sink: every output row is computed, none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from millrace.session import build_session
from millrace.workload import QUERIES
from millrace.workspace import LOCAL_ROOT

HEADLINE = (
    "task_orders conflict_rename join_left_multi join_chain join_null_key sum_group avg_group sum_global "
    "mode_value pivot_sum pivot_global combine arith_div split_merge doc_flatten wide_row csv_roundtrip "
    "sink_upsert auto_key profile_numeric profile_deciles profile_moments outliers_3 verdict_numeric "
    "verdict_category quality_report run_iterations usage_gap usage_functions related_edges "
    "lineage_process_nodes stream_window_verdict stream_drift"
).split()


def session(cpus: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
        "spark.checkpoint.dir": LOCAL_ROOT,
    }
    return build_session("bench", f"local[{cpus}]", **settings)


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(arguments: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names, runs = (list(HEADLINE), 3) if not arguments else (arguments, 3)
    if arguments == ["all"]:
        names, runs = list(QUERIES), 1
    spark = session(cpus)
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name:32s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
