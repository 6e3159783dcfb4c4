"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default: all headline queries).

Each query is fully materialised with the ``noop`` sink (every column is
computed, nothing is collected to the driver) and timed after a warm-up,
file listing and footers included.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanlens.plans import catalog, history  # noqa: E402
from loanlens.session import get_spark, scratch_scope  # noqa: E402

HEADLINE = [
    "wide_mart", "two_level_rollup", "join_balance", "instalment_mart", "rollup_balance",
    "mode_binned", "mode_text", "group_null_key", "impute_constants", "filter_ge_drop_null",
    "skew_report", "skew_log_positive", "skew_log_shifted", "standardise", "one_hot",
    "row_median", "bin_days", "auc_rank", "f1_threshold",
    # standalone marts and cleaning steps (added in round 1 after the first bench)
    "feature_mart", "prev_mart", "card_mart", "pos_mart", "row_features", "clean_previous",
    "clean_application",
    "f1_grid", "csv_roundtrip", "bundle_load", "encode_matrix", "score_average", "train_score",
    # comparisons, time joins and the stateful stream
    "auc_compare", "asof_status", "overlap_credits", "arrears_runs", "stream_rollup",
]


QUERIES = {**catalog.QUERIES, **history.QUERIES}


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), extra={"spark.driver.memory": "8g"})
    # Warm-up (untimed): one pass over the same queries on the smallest scale
    # factor, so JIT and codegen caches are hot and the timed pass measures
    # steady-state throughput rather than JVM start-up.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            with scratch_scope(spark):
                QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        fn = QUERIES[name]
        t0 = time.perf_counter()
        with scratch_scope(spark):
            fn(spark, d).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", d)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else d,
           "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
