"""Time every registered job and print one JSON line.

All jobs run once to warm up, then each BENCH_RUNS times; the median is
reported. The star tables are derived and written before the clock starts, as
a stored fact table would be; that time is reported as `star_build`. The
customer scores are computed afresh in every run of FRESH_SCORES; the other
jobs that read them find them stored, as they do in use.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from ledgerlens.jobs import JOBS
from ledgerlens.session import local_session, temporary_tables
from ledgerlens.sources.order_star import order_star
from ledgerlens.sources.schema import SCHEMAS
from ledgerlens.sources.star import Star

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
FRESH_SCORES = ("a3_customer_risk_scores",)
ONLY = tuple(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))


def main() -> None:
    spark = local_session(CPUS, "20g")
    started = time.perf_counter()
    stored = order_star(spark, FOLDER)
    for name in SCHEMAS:
        stored.table(name)
    build = time.perf_counter() - started

    def run(name: str) -> float:
        begin = time.perf_counter()
        fresh = Star(spark, stored.table)
        with temporary_tables(spark), fresh:
            star = fresh if name in FRESH_SCORES else stored
            JOBS[name](star).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - begin
        return seconds

    names = [name for name in JOBS if not ONLY or name.startswith(ONLY)]
    for name in names:
        run(name)
    seconds = {name: round(statistics.median(run(name) for _ in range(RUNS)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "median wall time of all jobs, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "star_build": round(build, 3),
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
