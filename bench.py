"""Times the registered queries and prints one JSON line.

The flagship query runs once to warm up. Then each query is timed from its
construction until its whole result has been computed and discarded. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma
separated, default all) choose what is run.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from listingflow import catalog  # noqa: E402
from listingflow.session import get_session  # noqa: E402


def run(spark, name: str, data: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(catalog.QUERIES)
    spark = get_session("listingflow-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "active_awards_by_type", data)
    times = {}
    for name in names:
        times[name] = round(run(spark, name, data), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over all queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf"),
        "cpus": cpus}))


if __name__ == "__main__":
    main()
