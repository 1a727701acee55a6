"""Headline timings. Prints one JSON line.

Every query is written to Spark's ``noop`` sink, so all of its columns are
computed. Plans run in batches of 1, 100, 1000 and all queries.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

BATCHES = (1, 100, 1000)


def main():
    from transitrisk import catalog as C
    from transitrisk.plans.journeys import plan
    from transitrisk.session import build_session
    from transitrisk.sources import testdata as V

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def run(name, make):
        t0 = time.time()
        try:
            make().write.format("noop").mode("overwrite").save()
        except Exception as ex:  # noqa: BLE001 - one failing query must not lose the others
            extra[f"{name}_error"] = f"{type(ex).__name__}: {str(ex)[:200]}"
        times[name] = round(time.time() - t0, 3)

    # warm-up: JVM, Python workers
    C.REGISTRY["trip_pool"](spark, sf_dir).collect()

    for name, query in (("timetable_build", "support_filter"), ("bridge_repair", "bridge_repair"),
                        ("delay_percentiles", "delay_percentiles"), ("kmeans_labels", "kmeans_labels"),
                        ("cluster_gamma", "cluster_gamma"), ("walk_pairs", "walk_pairs"),
                        ("transfer_table", "transfer_cutoff")):
        run(name, lambda q=query: C.REGISTRY[q](spark, sf_dir))
    run("journey_timetable", lambda: C._ride_timetable(spark, sf_dir).rides)

    for mode in ("depart", "arrive"):
        queries = V.plan_queries(C._events(spark, sf_dir), mode).cache()
        total = queries.count()
        for n in (*BATCHES, total) if mode == "depart" else (total,):
            batch = queries.orderBy("query_id").limit(min(n, total))
            name = f"plan_{mode}" + ("" if n == total else f"_{n}")
            run(name, lambda b=batch: plan(b, C._ride_timetable(spark, sf_dir))[0])
            extra[f"{name}_sec_per_query"] = round(times[name] / min(n, total), 4)
    run("isochrone", lambda: C.REGISTRY["isochrone"](spark, sf_dir))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "detail": extra, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
