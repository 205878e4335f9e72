"""Times the headline queries; prints one JSON line.

Each query is forced by a ``noop`` write, once to warm up and then three times;
the median counts.  ``BENCH_SHAPE=1`` adds the published workload's shape (1 M
orders, 3 M lines, synthesised by arithmetic).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators import scd2  # noqa: E402
from tidemark.operators.versions import latest_live  # noqa: E402
from tidemark.plans import marts, queries  # noqa: E402
from tidemark.sources import synth  # noqa: E402

HEADLINE = (
    "fact_asof_price scd2_part_price scd2_user_state revenue_daily funnel_daily cohort_retention top_products_daily inventory_current "
    "pipeline_health refresh_chain dq_summary conflicting_versions reconcile_buckets revenue_by_category retention_pivot"
).split()


def seconds(make, runs: int) -> float:
    took = []
    for _ in range(runs + 1):
        t = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return round(median(took[1:]), 3)


def shape(spark: SparkSession, runs: int) -> dict[str, float]:
    """Dimension rebuilds, the fact scan and the marts on tables of the published shape, saved first."""
    root = f"{tempfile.gettempdir()}/tidemark-bench-{os.getpid()}"  # one machine, local mode
    tables = {}
    for name, df in synth.bench_tables(spark, 1_000_000).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    orders = lambda: latest_live(tables["orders"], ["order_id"], ["version"])
    items = lambda: latest_live(tables["items"], ["order_item_id"], ["version"])
    dim = lambda: scd2.build(tables["products"], "product_id", ["name", "category", "price"])
    fact = lambda: marts.fact_orders(items(), orders(), dim(), marts.hot_products(tables["items"], items(), orders()))
    jobs = {
        "shape_dim_customers": lambda: scd2.build(tables["customers"], "customer_id", ["name", "address", "segment"]),
        "shape_dim_products": dim,
        "shape_fact": fact,
        "shape_revenue": lambda: marts.revenue_daily(fact()),
        "shape_funnel": lambda: marts.funnel_daily(orders(), tables["history"]),
        "shape_cohort": lambda: marts.cohort_retention(orders(), F.lit("2026-02-01").cast("timestamp"), tables["orders"]),
        "shape_top_products": lambda: marts.top_products_daily(fact(), marts.newest_names(tables["products"])),
        "shape_inventory": lambda: marts.inventory_current(latest_live(tables["stock"], ["product_id", "warehouse_id"], ["version"]), marts.newest_names(tables["products"])),
    }
    return {n: seconds(f, runs) for n, f in jobs.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    got = {n: seconds(lambda n=n: queries.QUERIES[n](spark, sf_dir), runs) for n in HEADLINE}
    if os.environ.get("BENCH_SHAPE"):
        got |= shape(spark, runs)
    name = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline queries, summed medians", "value": round(sum(got.values()), 3), "unit": "sec", "queries": got, "sf": float(name.removeprefix("sf")) if name.startswith("sf") else name}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
