"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from hindsight.plans import load_all
from hindsight.plans.registry import QUERIES
from hindsight.session import build_session

# one query or more from every family
HEADLINE = [
    "A05_dump_ingest", "A12_assign_cycle", "A13_parse_commit_log", "A16_run_flags", "B04_state_at", "B08_trace_signal",
    "B12_snapshot", "B19_memory_hop", "B22_lockstep_diff", "C08_stall_report", "D03_hier_slice", "D05_evaluate",
    "E03_grep", "E09_validate_proposal", "F01_token_sites", "F09_classify_outcome", "F12_plan_window",
    "G07_episode_dedupe", "G08_paired_diff", "G14_behaviour", "G23_integrity_audit",
    # the slowest of the others
    "A23_fanin_extract", "B13_source_of", "D06_responsible", "D07_why", "D09_why_cross_memory", "D10_chain_digest", "G12_token_ratio", "G18_trajectory",
]

# seconds after which a query is not repeated
ENOUGH = 30


def run(df) -> None:
    """Execute everything and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds = {}
    for name in names:
        times = []
        began = time.monotonic()
        run(QUERIES[name](spark, folder))  # warm-up
        while len(times) < repeats and (not times or time.monotonic() - began < ENOUGH):
            t0 = time.monotonic()
            run(QUERIES[name](spark, folder))
            times.append(time.monotonic() - t0)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
