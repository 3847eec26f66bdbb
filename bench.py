"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeline.catalog import QUERIES  # noqa: E402
from gaugeline.session import build_session  # noqa: E402

HEADLINE = [
    "rule_batch_results", "check_not_null_blank", "check_compare_value", "check_date_order", "check_unique", "check_unique_rows", "check_referential",
    "failed_ids_top", "key_discovery", "generated_key", "failed_profile", "failed_values", "auto_join", "filter_ids", "touched_tables", "involved_tables",
    "rule_columns_fallback", "column_type_map", "token_set_score", "weighted_match", "two_hop_scoped", "entity_extract", "vector_topk", "run_log", "run_rank",
    "run_ids", "remediate_fillna", "remediate_deduplicate_lines", "remediate_multi", "remediate_audit", "rules_suggest", "turn_context", "doc_chunks",
    "doc_windows", "bm25_topk", "hybrid_rrf", "filtered_topk", "doc_mappings", "direct_lookup", "dashboard",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "gaugeline-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small job first, so that starting the JVM is not charged to the first query.
    QUERIES["rule_batch_results"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
