"""The newest event behind each mart, told without making the marts."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import marts, queries
from tidemark.sources import synth

SF = "/root/testdata/sf0.001"


def views(s):
    return {"items": queries.items_live(s, SF), "orders": queries.orders_live(s, SF), "all_orders": synth.stg_orders(s, SF), "stock": queries.stock_live(s, SF)}


def told(found):
    rows = [df.select(F.lit(n).alias("n"), F.unix_micros("source_watermark").alias("t")) for n, df in found.items()]
    return {r["n"]: r["t"] for r in reduce(DataFrame.unionAll, rows).collect()}


@pytest.mark.parametrize("case", ["all", "no items", "no orders", "no stock", "all cancelled", "all of the future"])
def test_watermarks_are_those_of_the_marts(spark, case):
    v = views(spark)
    if case == "no items":
        v["items"] = v["items"].where("false")
    if case == "no orders":
        v["orders"] = v["orders"].where("false")  # all of them deleted; their rows are still there
    if case == "no stock":
        v["stock"] = v["stock"].where("false")
    if case == "all cancelled":
        v["orders"] = v["orders"].withColumn("status", F.lit("cancelled"))
    as_of = queries.when("1990-01-01" if case == "all of the future" else queries.AS_OF)
    fact = marts.fact_orders(v["items"], v["orders"], queries.dim_products(spark, SF))
    names = queries.names(spark, SF)
    made = {
        "revenue_daily": marts.revenue_daily(fact), "funnel_daily": marts.funnel_daily(v["orders"], synth.stg_status_history(spark, SF)), "cohort_retention": marts.cohort_retention(v["orders"], as_of, v["all_orders"]),
        "top_products_daily": marts.top_products_daily(fact, names), "inventory_current": marts.inventory_current(v["stock"], names),
    }
    want = told({n: df.agg(F.max("source_watermark").alias("source_watermark")) for n, df in made.items()})
    assert told(marts.watermarks(**v, as_of=as_of)) == want
    assert (None in want.values()) == (case != "all")


def test_freshness_makes_no_mart_and_tells_the_age_of_empty_ones(spark, tmp_path):
    plan = queries.QUERIES["freshness"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "last(" not in plan and "valid_from" not in plan
    for t in ("orders", "lineitem", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = queries.QUERIES["freshness"](spark, str(tmp_path)).collect()
    assert [(r["mart"], r["refresh_age"], r["source_lag"]) for r in rows] == [(m, 120, None) for m in sorted(queries._MARTS)]
