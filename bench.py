"""Time the headline queries and print one line of JSON.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Every query runs
over its whole tables; results are written to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import re
import time

from scanloom.plans.catalog import QUERIES
from scanloom.session import build_session

HEADLINES = (
    "documents_secrets_by_lang",
    "documents_redacted",
    "pages_secret_lines",
    "conversations_code",
    "corpus_lines",
    "js_secrets",
    "js_sql",
    "py_exec",
    "findings_all",
    "findings_with_rule",
    "gate_by_file",
    "gate_by_repo",
    "gate_corpus",
    "orders_gate_by_repo",
    "summary_rollup",
    "rule_frequency",
    "rule_priority",
    "report_lines",
    "evaluate_file",
    "evaluate_case",
    "patch_requests",
    "verify_patches",
    "finding_changes",
    "line_delta",
    "stream_findings",
    "stream_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the Python workers and compiles the common code.
    QUERIES["gate_corpus"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
