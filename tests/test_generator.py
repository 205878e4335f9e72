from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import generator as g


@pytest.fixture(scope="module")
def actions(spark):
    return g.load(spark, 40_000, 0.25, 11).persist()


def test_shares_times_and_seeds(spark, actions):
    n = actions.count()
    got = {r["action"]: r["count"] / n for r in actions.groupBy("action").count().collect()}
    assert got.keys() == g.ACTIONS.keys() and all(abs(got[a] - s) < 0.02 for a, s in g.ACTIONS.items())
    by_hour = {r["h"]: r["count"] for r in actions.groupBy(((F.hour("at") + 3) % 24).alias("h")).count().collect()}
    assert by_hour[19] > 8 * by_hour[3]
    span = actions.agg((F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at"))).alias("s")).first()["s"]
    assert abs(span - 40_000 / 0.25) < 0.05 * 40_000 / 0.25
    ordered = [r["at"] for r in actions.orderBy("id").limit(2000).collect()]
    assert ordered == sorted(ordered)
    again = g.load(spark, 40_000, 0.25, 11, block=777)
    assert actions.exceptAll(again).isEmpty() and not actions.exceptAll(g.load(spark, 40_000, 0.25, 12)).isEmpty()


def test_orders_take_what_is_there(spark, actions):
    stock = spark.range(90).select((F.col("id") % 30).alias("product_id"), (F.floor(F.col("id") / 30) + 1).cast("int").alias("warehouse_id"), (F.col("id") % 7 * 40).cast("int").alias("quantity"))
    prices = spark.range(30).select(F.col("id").alias("product_id"), (F.col("id") + 1).cast("decimal(10,2)").alias("price"))
    orders, items, left = g.new_orders(actions, 500, stock, prices, 3)
    lines = items.collect()
    per = {}
    for r in lines:
        per.setdefault(r["order_id"], []).append(r)
        assert 1 <= r["quantity"] <= 3 and r["price_at_order"] == r["product_id"] + 1
    assert all(1 <= len(v) <= 5 and len({r["product_id"] for r in v}) == len(v) for v in per.values())
    assert {r["order_id"] for r in orders.collect()} == set(per) and {r["status"] for r in orders.collect()} == {"created"}
    rest = {(r["product_id"], r["warehouse_id"]): r["quantity"] for r in left.collect()}
    had = {(r["product_id"], r["warehouse_id"]): r["quantity"] for r in stock.collect()}
    assert min(rest.values()) >= 0 and sum(had.values()) - sum(rest.values()) == sum(r["quantity"] for r in lines)


def test_steps_are_legal(spark, actions):
    orders = spark.range(20_000).select(F.col("id").alias("order_id"), F.element_at(F.array(*map(F.lit, ["created", "paid", "shipped", "delivered", "cancelled"])), (F.col("id") % 5 + 1).cast("int")).alias("status"))
    rows = g.advanced_orders(actions, orders, 5).collect()
    wanted = actions.where("action = 'advance_order'").count()
    assert abs(len(rows) - min(wanted, 12_000)) < 0.1 * min(wanted, 12_000)
    assert all(r["status"] in g.STEPS[r["before"]] for r in rows)
    share = sum(r["status"] == "cancelled" for r in rows if r["before"] == "created") / sum(r["before"] == "created" for r in rows)
    assert abs(share - 0.15) < 0.05


def test_changes_always_change(spark, actions):
    customers = g.new_customers(actions, 100, 7).persist()
    assert customers.count() == actions.where("action = 'new_customer'").count() and customers.agg(F.count_distinct("customer_id")).first()[0] == customers.count()
    old = {r["customer_id"]: r for r in customers.collect()}
    new = g.updated_customers(actions, customers, 8).collect()
    assert len(new) > 100 and all((r["address"], r["segment"]) != (old[r["customer_id"]]["address"], old[r["customer_id"]]["segment"]) for r in new)
    products, shelves = g.new_products(actions, 50, 9)
    assert shelves.count() == 3 * products.count() and shelves.where("quantity < 20 OR quantity > 200").isEmpty()
    many = spark.range(300).select(F.col("id").alias("product_id"), F.lit("x").alias("name"), F.lit("books").alias("category"), F.when(F.col("id") % 2 == 0, F.lit("1.00")).otherwise(F.lit("99999999.99")).cast("decimal(10,2)").alias("price"))
    was = {r["product_id"]: r for r in many.collect()}
    got = g.updated_products(actions, many, 10).collect()
    assert len(got) > 200 and all((r["price"], r["category"]) != (was[r["product_id"]]["price"], "books") and Decimal(1) <= r["price"] <= Decimal('99999999.99') for r in got)


def test_restock_one_of_the_emptiest(spark, actions):
    stock = spark.range(50).select(F.col("id").alias("product_id"), F.lit(1).alias("warehouse_id"), F.col("id").cast("int").alias("quantity"))
    r = g.restocked(actions, stock, 4).collect()
    assert len(r) == 1 and r[0]["product_id"] < 10 and r[0]["quantity"] > 50
    assert g.restocked(actions.where("action = 'new_order'"), stock, 4).isEmpty()
