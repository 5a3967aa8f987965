"""Seconds per headline query, printed as one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads. Each query
runs once to warm up and three times for the median; results go to Spark's noop
sink, so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

HEADLINE = [
    "a1_usage_history_daily", "a1_usage_history_monthly", "a3_feature_breakdown_by_org", "a4_quota_status",
    "a7_dashboard", "a14_describe_numeric", "a16_job_progress", "a19_pii_census", "f1_filter_events",
    "f4_search_any_column", "j5_nest_line_items", "j8_cost_fuzzy", "j10_reuse_lookup", "w1_latest_generation",
    "w3_recent_per_org", "w8_admit_uploads", "u3_dedupe_requests", "u4_dedupe_content_groups", "m1_upsert",
    "m10_rebuild_counters", "m11_apply_deltas", "t1_estimate_tokens", "t7_scrub_redact", "t8_classify_intent",
    "x3_extract_records", "x6_upsert_records", "r1_chunk_documents", "r3_keyword_topk", "r4_semantic_topk",
    "r7_cache_lookup", "e6_admission_batch", "e7_sessionise", "f7_sql_rollup", "f7_sql_count_distinct",
]
# streams replay the table through files, so one run each
STREAMS = ["e1_ingest_usage", "e4_ingest_uploads"]


def run(fn, spark, root) -> float:
    began = time.perf_counter()
    fn(spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE + STREAMS
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in wanted:
        fn = queries[name]
        if name in STREAMS:
            seconds[name] = round(run(fn, spark, root), 4)
            continue
        run(fn, spark, root)
        seconds[name] = round(statistics.median(run(fn, spark, root) for _ in range(3)), 4)
    scale = os.path.basename(root.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
