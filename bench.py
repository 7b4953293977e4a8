"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall times (seconds, each query
fully materialised with a row count)."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import registry  # noqa: E402
from quire.session import build_session, cut_scope  # noqa: E402

HEADLINE = [
    "curate_new_entries",       # P1, P2, J1, J2, J3, A5, W8, P7 end to end
    "similar_document_counts",  # J2 on whole documents
    "doi_backfill",             # P6, J7, J8, J9
    "search_hits",              # Q1
    "schema_violations",        # V1
    "top_categories",           # H12, A7, W4
    "category_ranked",          # P9, W5
    "control_entries",          # J6, A10, W6
    "ingest_keep_first",        # A1
    "page_title_keep_first",    # J3 alone
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm the JVM once so the first query does not pay for it
    spark.range(1000).selectExpr("sum(id)").collect()
    times, rows = {}, {}
    for name in names:
        t0 = time.perf_counter()
        with cut_scope(spark):   # intermediate tables are dropped after each query
            rows[name] = registry.QUERIES[name](spark, sf_dir).count()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows,
                      "sf": float(m.group(1)) if m else None, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
