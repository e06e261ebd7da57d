"""Headline queries at one scale: one warm-up, then the median of timed runs.

Prints one JSON line. Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillframe.checks.queries import QUERIES  # noqa: E402
from quillframe.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = {
    "changed_documents": "jon1_changed_files",
    "work_order": "srt1_work_order",
    "filtered_top_5": "flt6_metadata_filter",
    "top_5_of_all": "jon6_vector_top_k",
    "retrieval_packing": "agg9_packed_context",
    "import_context": "jon9_import_context",
    "symbol_extraction": "udf1_symbol_extraction",
    "batch_embedding": "udf4_batch_embedding",
    "line_diff": "set4_line_diff",
    "directory_rollup": "agg7_directory_rollup",
    "last_message": "win2_last_message",
    "budget_packing": "win1_token_budget_packing",
    "batch_validation": "agg1_batch_validation",
    "change_reports": "agg3_folder_change_reports",
    "prompts": "scl9_prompt_columns",
    "source_scan": "src1_scan_source_tree",
    "whole_run": "run_first",
    "resumed_run": "run_second",
}


def timed(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    shared = tempfile.mkdtemp(prefix="quillframe-bench-")  # one machine: every task reaches it
    spark = build_session(
        "quillframe-bench", f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__checkpoint__dir=shared, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for label, name in HEADLINE.items():
        timed(spark, name)
        seconds[label] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
