"""Wall seconds of the headline queries; prints one JSON line.

$BENCH_SF_DIR (default /root/testdata/sf0.1) and $BENCH_CPUS (default 8) set the run. Each
query runs once to warm up, then $BENCH_RUNS times (default 3); the median counts. Results go
to Spark's noop sink, so all rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from hourloom.catalogue import queries
from hourloom.session import local_session

HEADLINE = [
    "r01_cards_current_year",
    "r01_cards_all",
    "r05_facets",
    "r07_page",
    "r07_page_done",
    "r09_by_year_month",
    "r09_by_project_size",
    "r09_by_user_fixed",
    "r09_by_relevant_project",
    "r09_by_all_fields",
    "r10_lines_month",
    "r12_gaps",
    "r13_matrix_long",
    "r15_gantt",
    "r16_detail",
    "r18_contiguity",
    "r19_grid",
    "r19_grid_plain",
    "r25_lookup",
    "r27_project_colours",
    "m01_upsert",
    "m01_over_snapshot",
    "m02_fold",
    "m02_over_snapshot",
    "m04_insert",
    "s01_stream",
    "d01_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    seconds = {}
    for name in names:
        took = []
        for i in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or not runs:
                took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, median wall time, sum",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else sf_dir,
                "cpus": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
