"""Wall time of headline queries: prints one JSON line.

Every query runs twice into a no-op sink and the faster run counts. Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpuslens.plans import catalog
from corpuslens.session import local_session

HEADLINE = (
    "a1_file_coverage a2_block_counters a4_run_summary_by_supplier a12_change_summary a13_diagnostic_funnel "
    "s1_redact_documents s2_scrub_payload f7_inclusion l2_bounded_scan l3_listing_preview l4_log_tail "
    "b1_b5_block_spans b6_block_analysis b7_module_rows e1_evidence e2_a6_sections j9_module_matches "
    "j1_j2_reuse a14_suggestions_by_file j5_match_bottom_up w5_budget w6_patched_lines j6_path_diff "
    "j3_runs_with_repository w3_retention w4_carried_artifacts w9_recent_per_repository r6_reconciled r7_lifecycle "
    "st1_rate_limit"
).split()


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cpus, shuffle_partitions=max(int(cpus), 1) if cpus.isdigit() else 8)
    available = catalog.queries()
    available["a1_file_coverage"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
