"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Each query runs once
to warm up and then ``BENCH_RUNS`` times; the median counts. Results go to Spark's no-op
sink, so that all of a result is computed and none of it is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

REGISTERED = """
node_graph node_aggregate node_dedup node_join_inner prefilter_aggregate
profile_columns profile_texts dataset_profile duplicate_rows fingerprint
metric_trend_month metric_kpi_30d metric_breakdown
key_overlap suggest_ontology entity_table relationship_coverage two_hop_agreement
objects relations link_counts top_degree_graph k_hop record_sort effective_records apply_edits
daily_event_counts event_properties activity_feed collapse_all collapse_adjacent connection_health threads
cdc_dirty_counter publish_generation snapshot_commit
""".split()


def session():
    from pyspark.sql import SparkSession

    from ontoweave.session import configure

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def ingest_profile(spark):
    """JSON lines of four columns into a profiled snapshot: landing, writing, profiling."""
    from ontoweave.operators.snapshots import Snapshots
    from ontoweave.sources import files
    from pyspark.sql import functions as F
    from workload.data import scratch, table

    root = scratch(spark)
    lines = table(spark, SF_DIR, "lineitem").select(
        F.monotonically_increasing_id().alias("id"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("status"),
    )
    files.export(lines, f"{root}/orders.jsonl", "jsonl")

    def run():
        store = Snapshots(spark, scratch(spark))
        store.ingest("orders", "Orders", f"{root}/orders.jsonl", version="v1")

    return run


def concurrent_group_by(spark, queries: int = 25):
    """Many questions at once over one snapshot; returns the median seconds of one."""
    from workload.data import table

    lines = table(spark, SF_DIR, "lineitem")
    from ontoweave.operators.query import sql_over

    text = "SELECT l_returnflag, sum(l_extendedprice) AS revenue, count(*) AS orders FROM lines GROUP BY l_returnflag"

    def one(_):
        start = time.time()
        sql_over({"lines": lines}, text).collect()
        return time.time() - start

    def run():
        with ThreadPoolExecutor(queries) as pool:
            return statistics.median(pool.map(one, range(queries)))

    return run


def measure(run) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.time()
        own = run()
        times.append(own if isinstance(own, float) else time.time() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    import workload.registry as registry

    spark = session()
    only = sys.argv[1:]
    jobs = {"ingest_profile": ingest_profile, "concurrent_group_by_median": concurrent_group_by}
    results = {}
    for name in [*jobs, *REGISTERED]:
        if only and name not in only:
            continue
        run = jobs[name](spark) if name in jobs else lambda q=registry.QUERIES[name]: consume(q(spark, SF_DIR))
        results[name] = measure(run)
        print(f"{name} {results[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
