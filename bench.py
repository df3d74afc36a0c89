"""Time the headline queries: median of three runs after a warm-up, printed as one JSON line.

Reads ``BENCH_SF_DIR`` (default the 0.1 folder) on ``local[BENCH_CPUS]``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexweave.plans import registry  # noqa: E402
from lexweave.session import build_session  # noqa: E402

HEADLINE = (
    "q_surface",
    "q_fingerprint",
    "q_mask_slots",
    "q_row_contract",
    "q_rewrite",
    "q_region_detect",
    "q_gate_cascade",
    "q_lexicon_match",
    "q_profile",
    "q_dup_accentless",
    "q_prev_dup",
    "q_dedupe_priority",
    "q_group_split",
    "q_quota",
    "q_near_dup",
    "q_cross_split_anti",
    "q_tfidf_word",
    "q_class_report",
    "q_threshold_sweep",
    "q_ranking",
    "q_measure_summary",
    "q_parse_corpus",
)
RUNS = 3


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    frame = registry.QUERIES[name](spark, folder)
    # The no-op sink computes every column of every row and keeps none.
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", RUNS))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    line = {
        "metric": "total_median_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
