"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from jobledger.plans.catalog import QUERIES
from jobledger.session import get_session
from jobledger.sources.archive import daily_rollup, full_archive

HEADLINE = [
    "flagship_top_sites", "a07_rollup_day", "a07_rollup_month", "a17_coarsen_day_to_week", "a20_merge_rollups",
    "a08_metric_by_site", "a13_suggestions", "a14_performance_bundle", "a12_status",
    "p20_find_in_timerange", "p06_output_attribute", "p11_path_through_arrays", "n12_flatten_errors",
    "n13_flatten_outputs", "a03_storage_stats", "a05_avg_event_cpu", "a19_duplicate_jobs",
    "j02_producers", "j04_trace_from_job_outputs", "w05_stack_states", "v01_validation_errors",
    "k01_append_new", "k12_route", "t02_ingest_stream", "t06_notify_stream", "t07_live_rollup", "x03_emit_reduce",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    start = time.time()
    full_archive(spark, sf_dir)
    times["build_archive"] = round(time.time() - start, 3)
    start = time.time()
    daily_rollup(spark, sf_dir)
    times["build_rollup"] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
