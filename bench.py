"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Extra Spark settings: BENCH_CONF="key=value,key=value".
Each query is run once to warm the JVM / codegen caches, then timed over
``BENCH_REPS`` runs (median); the result is consumed with the ``noop`` sink
so the whole plan executes without collecting to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from relaysync.plans import queries as Q  # noqa: E402
from relaysync.session import get_spark  # noqa: E402

HEADLINE = ["all_requests", "redelivery_outcomes", "triples_after_delete", "stream_requests"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    extra = {"spark.driver.memory": "16g"}
    for kv in filter(None, os.environ.get("BENCH_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        extra[k] = v
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=parts, extra=extra)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        fn = Q.QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "events": n_events,
        "events_per_sec": {k: round(n_events / v, 1) for k, v in times.items() if v > 0},
        "cpus": cpus,
        "shuffle_partitions": parts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
