"""What goes through shuffles, and over how many tasks."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import quality, scd2
from tidemark.operators.asof import asof_left_join
from tidemark.plans import marts
from tidemark.sources import synth


def test_groups_and_their_watermark_read_one_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("a"), F.timestamp_seconds("id").alias("t"))
    out = marts._with_watermark(rows.groupBy("a").agg(F.count("*").alias("n"), F.max("t").alias("_newest")))
    assert out.columns == ["a", "n", "source_watermark"]
    assert {(r["n"], r["source_watermark"]) for r in out.withColumn("source_watermark", F.unix_seconds("source_watermark")).collect()} == {(100, 999)} and out.count() == 10
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_a_group_without_any_event_keeps_the_watermark(spark):
    rows = spark.createDataFrame([(1, None), (2, datetime(2020, 1, 2))], "a long, t timestamp")
    out = marts._with_watermark(rows.groupBy("a").agg(F.max("t").alias("_newest")))
    assert [r["source_watermark"] for r in out.collect()] == [datetime(2020, 1, 2)] * 2
    none = marts._with_watermark(rows.where("a = 1").groupBy("a").agg(F.max("t").alias("_newest")))
    assert [r["source_watermark"] for r in none.collect()] == [None]


def test_narrow_rows_are_dealt_before_they_grow(spark):
    assert synth.dealt(spark.range(1000), "id", 100).rdd.getNumPartitions() == 10
    assert sorted(r["id"] for r in synth.dealt(spark.range(1000), "id", 100).collect()) == list(range(1000))
    few = spark.range(150).coalesce(1)
    assert synth.dealt(few, "id", 100) is few


def test_hashes_of_lines_are_made_behind_their_shuffle(spark):
    t = {
        "stg_orders": spark.createDataFrame([], "order_id long, customer_id long, status string, created_at timestamp, updated_at timestamp, event_time timestamp, version long, is_deleted int"),
        "stg_order_items": spark.createDataFrame([], "order_item_id long, order_id long, product_id long, quantity int, price_at_order decimal(10,2), event_time timestamp, version long, is_deleted int"),
        "stg_order_status_history": spark.createDataFrame([], "order_id long, status string, changed_at timestamp, version long"),
        "fact_orders": spark.createDataFrame([], "order_item_id long"),
        "dim_customers": spark.createDataFrame([], "customer_id long, is_current int"),
        "dim_products": spark.createDataFrame([], "product_id long, is_current int"),
        "stg_product_versions": spark.createDataFrame([], "product_id long, version long, valid_from timestamp, category string, price decimal(10,2), is_deleted int"),
        "stg_inventory": spark.createDataFrame([], "product_id long, warehouse_id int, version long, quantity int, is_deleted int"),
        "mart_revenue_daily": spark.createDataFrame([], "order_date date, category string, revenue decimal(18,2), revenue_net decimal(18,2)"),
    }
    plan = quality.shared(t, F.lit("2020-01-01").cast("timestamp"))._jdf.queryExecution().analyzed().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression [order_item_id" in line)
    below = [line for line in plan[at + 1 :][: next((i for i, line in enumerate(plan[at + 1 :]) if depth(line) <= depth(plan[at])), len(plan))]]
    assert below and not any("xxhash64" in line for line in below)


JOURNAL = "k long, valid_from timestamp, a string, b string, is_snapshot int, is_deleted int, version long"


def test_a_dimension_sorts_its_journal_twice(spark):
    df = scd2.build(spark.createDataFrame([], JOURNAL), "k", ["a", "b"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Sort [") for line in plan.split("\n")) == 2  # newest of a time, order of versions
    assert "struct(" not in plan  # no row is carried twice


def test_tasks_of_a_dimension_grow_with_its_journal(spark):
    journal = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    assert scd2.spread(journal, "k", 10).rdd.getNumPartitions() == 100
    assert sorted(r["id"] for r in scd2.spread(journal, "k", 10).collect()) == list(range(1000))
    assert max(len({r["p"] for r in rows}) for rows in _by(scd2.spread(journal, "k", 10).select("k", F.spark_partition_id().alias("p")).collect()).values()) == 1


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["k"], []).append(r)
    return out


def test_a_snapshot_before_1970_keeps_its_place(spark):
    rows = [(1, datetime(1965, 1, 1), "x", "", 1, 0, 7), (1, datetime(1968, 1, 1), "y", "", 0, 0, 7), (1, datetime(1980, 1, 1), "z", "", 0, 0, 8)]
    df = scd2.build(spark.createDataFrame(rows, JOURNAL), "k", ["a", "b"])
    assert {(r["a"], r["valid_from"], r["valid_to"]) for r in df.collect()} == {("x", datetime(1970, 1, 1), datetime(1968, 1, 1)), ("y", datetime(1968, 1, 1), datetime(1980, 1, 1)), ("z", datetime(1980, 1, 1), None)}


def test_an_as_of_join_carries_what_is_asked_for(spark):
    left = spark.range(10).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("at"), F.concat(F.lit("unused "), F.col("id")).alias("c"), "id")
    right = spark.range(3).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") + 2).alias("since"), (F.col("id") * 10).alias("v"))
    joined = asof_left_join(left, right, "k", "at", "since", ["v"])
    assert joined.columns == ["k", "at", "c", "id", "v"] and joined.schema["k"].dataType == left.schema["k"].dataType
    assert {(r["id"], r["k"], r["c"], r["v"]) for r in joined.collect()} == {(i, i % 3, f"unused {i}", i % 3 * 10 if i >= i % 3 + 2 else None) for i in range(10)}
    assert "unused" not in joined.select("id", "v")._jdf.queryExecution().optimizedPlan().toString()


def test_orders_of_a_day_and_category_are_counted_without_sums_by_order(spark):
    rows = [(1, 1), (1, 2), (1, 1), (2, 1), (None, 1), (None, 3)]
    fact = spark.createDataFrame([(datetime(2020, 1, d), o, "paid", 2, d) for o, d in rows], "created_at timestamp, order_id long, status string, quantity int, cents int")
    fact = fact.select(F.to_date("created_at").alias("order_date"), F.when(F.col("cents") == 1, "a").alias("category"), "order_id", "status", "quantity", F.col("cents").cast("decimal(18,2)").alias("amount"), F.col("created_at").alias("event_time"))
    out = marts.revenue_sums(fact)
    assert {(r["order_date"].day, r["category"], r["orders"], r["items"], int(r["revenue"])) for r in out.collect()} == {(1, "a", 2, 8, 4), (2, "unknown", 1, 2, 2), (3, "unknown", 0, 2, 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate(" in line and "order_id" in line.split("functions=")[0] for line in plan.split("\n"))
