"""Benchmark: every registered query of the reference's operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each plan is executed in full through the ``noop`` sink (no rows are pulled
to the driver).  One warm-up pass, then a timed pass; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from recordaudit.session import local_session  # noqa: E402

from recordaudit.plans import catalog  # noqa: E402


def run_once(spark, fn, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 8), app="recordaudit-bench")
    qs = {k: v for k, v in catalog.QUERIES.items() if not only or k in only}
    for fn in qs.values():  # warm-up: JIT, file listing cache, Python workers
        run_once(spark, fn, sf_dir)
    times = {name: round(run_once(spark, fn, sf_dir), 3) for name, fn in qs.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
