"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once to warm up and then ``REPEATS`` times (``FEW`` for those of
``LONG``); its figure is the mean of the smallest runs that the trimmed-mean rule
keeps.  Beside the headline there are the seconds of ``star_topk`` by k, one run
each, and costs in rows of the anytime engine, which repeat exactly.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom import queries
from graphloom.functions.similarity import trimmed_mean_of
from graphloom.plans.anytime import AnytimeEngine, round_robin
from graphloom.plans.topk import Matcher

HEADLINE = ("star_topk", "multi_star_topk", "exact_match", "simulation_match", "pagerank", "triangle_count")
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))
LONG, FEW = ("pagerank",), min(REPEATS, 2)
MORE = ("pivot_topk",)
K_SWEEP = (1, 10, 20, 50, 100)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(df: Callable[[], DataFrame]) -> float:
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return time.perf_counter() - began

    for name in HEADLINE + MORE:
        runs = [timed(lambda name=name: queries.QUERIES[name](spark, sf_dir)) for _ in range((FEW if name in LONG else REPEATS) + 1)]
        times[name] = round(trimmed_mean_of(runs[1:]), 3)
    more = {name: times.pop(name) for name in MORE}
    sweep = {k: round(timed(lambda k=k: Matcher(queries.large(spark, sf_dir), queries.STAR, queries.PREFIX, queries.THETA).top(k)), 3) for k in K_SWEEP}
    costs = {}
    for name, query in (("star", queries.STAR), ("chain", queries.CHAIN)):
        began, engine = time.perf_counter(), AnytimeEngine(Matcher(queries.large(spark, sf_dir), query, queries.PREFIX, queries.THETA), 10)
        state = engine.run(round_robin(1000))[1]
        costs[name] = {
            "rows_fetched": state.fetched, "rounds": state.rounds, "star_rows": sum(state.sizes), "rows_made": sum(t.built for t in engine.tables), "pairs": sum(state.pairs),
            "seconds": round(time.perf_counter() - began, 1),
        }
        engine.m.close()
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "repeats": REPEATS, "pyspark": spark.version, "more": more, "star_topk_by_k": sweep, "costs": costs}))


if __name__ == "__main__":
    main()
