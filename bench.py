"""Times the registered queries: one JSON line on standard output.

Each query is run to the end into a sink that keeps nothing.  A first, untimed run of a
small query pays for the session's start.
"""

from __future__ import annotations

import json
import os
import time

from docloom.plans.queries import QUERIES
from docloom.session import local_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else list(QUERIES)
    spark = local_session(cpus, "docloom-bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["function_pairs"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    begun = time.perf_counter()
    n_functions = QUERIES["function_pairs"](spark, folder).count()
    rate = n_functions / (time.perf_counter() - begun)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus, "documented_functions_per_sec": round(rate, 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
