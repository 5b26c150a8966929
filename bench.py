"""Benchmark: every named result at $BENCH_SF_DIR on local[$BENCH_CPUS].

The cleaned collections and the shared derived tables are written once
("prepare", timed on its own, into a fresh folder under the shared checkpoint
folder).  Then each result is forced in
full with a ``noop`` write - no collect - once cold, then ``WARM_RUNS`` times warm
(the best warm run is kept, to damp machine noise).  ``from_cleaned`` times the results that
read a shared derived table once more without any: from the cleaned collections alone.
Prints one JSON line; ``value`` is the sum of the warm per-query times.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from biblioscope.plans.catalog import QUERIES, RESULTS, prepare  # noqa: E402
from biblioscope.session import build_session, checkpoint_root  # noqa: E402
from biblioscope.sources.tables import Workspace, register_workspace  # noqa: E402


WARM_RUNS = 3


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


class CleanedOnly(Workspace):
    """A workspace that reads the written cleaned tables and computes every derived table anew."""

    def derived(self, name, build):
        return build()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", app="biblioscope-bench",
                          shuffle_partitions=2 * cpus,
                          conf={"spark.driver.memory": "16g"})
    root = f"{checkpoint_root(spark)}/biblioscope-bench-{uuid.uuid4().hex[:8]}"
    ws = register_workspace(Workspace.from_testdata(spark, sf_dir, table_root=root), sf_dir)
    t0 = time.perf_counter()
    prepare(ws)
    prepare_sec = time.perf_counter() - t0

    cold, warm = {}, {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        force(fn(spark, sf_dir))
        cold[name] = round(time.perf_counter() - t0, 3)
        runs = []
        for _ in range(WARM_RUNS):
            t0 = time.perf_counter()
            force(fn(spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        warm[name] = round(min(runs), 3)

    plain = CleanedOnly.from_testdata(spark, sf_dir, table_root=root)
    from_cleaned = {}
    for name, result in RESULTS.items():
        touched = []
        plain.derived = lambda key, build: touched.append(key) or build()
        df = result(plain)
        if touched and (not only or name in only):
            t0 = time.perf_counter()
            force(df)
            from_cleaned[name] = round(time.perf_counter() - t0, 3)

    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_warm_query_seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "from_cleaned": from_cleaned,
        "prepare_sec": round(prepare_sec, 3),
        "cold_total_sec": round(sum(cold.values()) + prepare_sec, 3),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
