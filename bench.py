"""Headline queries, timed: prints one JSON line.

    BENCH_SF_DIR  input folder, default /root/testdata/sf0.1
    BENCH_CPUS    local cores, default 8
    BENCH_QUERIES comma-separated names, default all headline queries
"""

from __future__ import annotations

import json
import os
import re
import time

from schemaweft.plans.queries import QUERIES
from schemaweft.session import local_session

HEADLINE = [
    "match_exact",
    "match_normalized",
    "match_trigram_topk",
    "match_sequence_ratio",
    "match_cupid",
    "match_flooding",
    "eval_report",
    "eval_coverage_curve",
    "audit_summary",
    "audit_tenants",
    "stability_shuffle_lost",
    "legacy_table",
    "legacy_date_format",
    "legacy_unit_change",
    "legacy_lineage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session(cpus, memory="12g", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in [q for q in wanted.split(",") if q] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
