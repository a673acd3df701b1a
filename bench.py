"""Benchmark: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full through the ``noop`` sink (every column is
computed, nothing is collected to the driver).  A small warm-up query runs
first so JVM and Python-worker start-up is not charged to the first query.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sanitize_stem",          # STRG-1 safe stems
    "rewrite_links",          # STRG-4 link rewriting
    "math_spans",             # STRG-8 two-pass math spans
    "log_lines",              # STRG-5/6 line framing
    "extract_text_blocks",    # UDF-1 native text parser
    "extract_html_documents",  # UDF-1 mapInArrow HTML parser
    "flagship",               # pages -> blocks -> counts -> unique names
    "unique_names_window",    # WIN-1
    "flat_export",            # export with names + links + images
    "library_upsert",         # SNK-1 snapshot
    "library_newest",         # SRT-1 listing order
    "job_lifecycle",          # STR-1 batch twin
    "throttle",               # WIN-3 greedy throttle
    "stalls",                 # WIN-5 gaps
    "stream_lifecycle",       # STR-1 streaming replay
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from quire.plans import all_queries
    from quire.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="quire-bench")
    qs = all_queries()
    names = only or HEADLINE
    qs["sanitize_stem"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
