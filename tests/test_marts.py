from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import marts, panels

D = datetime(2026, 3, 1, 12)
ITEM = "order_item_id long, order_id long, product_id long, quantity int, price_at_order decimal(10,2), event_time timestamp, version long, is_deleted int"
ORDER = "order_id long, customer_id long, status string, created_at timestamp, updated_at timestamp, event_time timestamp, version long, is_deleted int"
PRODUCT = "product_id long, valid_from timestamp, name string, category string, price decimal(10,2), is_snapshot int, is_deleted int, event_time timestamp, version long"
HISTORY = "order_id long, status string, changed_at timestamp, is_snapshot int, version long"
STOCK = "product_id long, warehouse_id int, quantity int, updated_at timestamp, event_time timestamp, version long, is_deleted int"


def order(i, status="paid", at=D, cust=1, deleted=0, version=1):
    return (i, cust, status, at, at, at, version, deleted)


def item(i, o, p=1, q=1, price="10.00", at=D):
    return (i, o, p, q, Decimal(price), at, i, 0)


@pytest.fixture
def fact(spark):
    items = [item(1, 1), item(2, 2, q=2), item(3, 1, p=9, price="5.00"), item(4, 77), item(5, 3)]
    orders = spark.createDataFrame([order(1), order(2, "cancelled")], ORDER)
    products = spark.createDataFrame([(1, datetime(2026, 1, 1), "p", "food", Decimal("11.00"), 0, 0, D, 1)], PRODUCT)
    return marts.fact_orders(spark.createDataFrame(items, ITEM), orders, products)


def test_fact_hides_orphans(fact):
    got = {r["order_item_id"]: (r["category"], r["list_price"], r["amount"]) for r in fact.collect()}
    assert got == {1: ("food", Decimal("11.00"), Decimal("10.00")), 2: ("food", Decimal("11.00"), Decimal("20.00")), 3: (None, None, Decimal("5.00"))}


def test_revenue(fact):
    rows = {r["category"]: (r["orders"], r["items"], r["revenue"], r["revenue_net"], r["source_watermark"]) for r in marts.revenue_daily(fact).collect()}
    assert rows == {"food": (2, 3, Decimal("30.00"), Decimal("10.00"), D), "unknown": (1, 1, Decimal("5.00"), Decimal("5.00"), D)}


def test_funnel(spark):
    orders = spark.createDataFrame([order(1, "delivered"), order(2, "shipped"), order(3, "paid"), order(4, "cancelled"), order(5, "created")], ORDER)
    hour = lambda h: datetime(2026, 3, 1, 12 + h)
    h = [(1, "created", D, 0, 1), (1, "paid", hour(1), 0, 2), (1, "delivered", hour(5), 0, 4), (2, "paid", hour(1), 0, 2), (3, "paid", hour(2), 0, 2), (4, "paid", hour(3), 1, 2), (4, "cancelled", hour(4), 0, 3)]
    r = marts.funnel_daily(orders, spark.createDataFrame(h, HISTORY)).first()
    assert (r["created"], r["paid"], r["shipped"], r["delivered"], r["cancelled"]) == (5, 4, 2, 1, 1)
    assert (r["median_to_paid"], r["p90_to_paid"], r["median_to_delivered"]) == (3600.0, 6480.0, 18000.0)
    r = marts.funnel_daily(orders, spark.createDataFrame([], HISTORY)).first()
    assert (r["paid"], r["median_to_paid"]) == (3, None)


def test_cohorts(spark):
    rows = [order(1, at=datetime(2026, 1, 5), cust=1), order(2, at=datetime(2026, 2, 5), cust=1), order(3, at=datetime(2026, 1, 6), cust=2), order(4, at=datetime(2026, 2, 9), cust=3), order(5, "cancelled", datetime(2026, 1, 1), 4), order(6, at=datetime(2026, 9, 1), cust=5)]
    got = marts.cohort_retention(spark.createDataFrame(rows, ORDER), F.lit("2026-03-15").cast("timestamp")).orderBy("cohort_month", "period").collect()
    assert [(r["cohort_month"].month, r["period"], r["customers"], r["returned"], r["is_partial"]) for r in got] == [(1, 0, 2, 2, 0), (1, 1, 2, 1, 0), (1, 2, 2, 0, 1), (2, 0, 1, 1, 0), (2, 1, 1, 0, 1)]
    assert {r["source_watermark"] for r in got} == {datetime(2026, 9, 1)}
    pivot = panels.cohort_pivot(marts.cohort_retention(spark.createDataFrame(rows, ORDER), F.lit("2026-03-15").cast("timestamp"))).collect()
    assert (pivot[0]["cohort"], pivot[0]["m0"], pivot[0]["m1"], pivot[0]["m2"]) == ("2026-01", 100.0, 50.0, None)


def test_top_products_and_stock(spark, fact):
    dim = spark.createDataFrame([(1, "new name", "food", 1, 5), (1, "old name", "food", 0, 1)], "product_id long, name string, category string, is_current int, version long")
    rows = {(r["product_id"], r["category"]): (r["product_name"], r["quantity"], r["quantity_net"]) for r in marts.top_products_daily(fact, marts.present_names(dim)).collect()}
    assert rows == {(1, "food"): ("new name", 3, 1), (9, "unknown"): ("unknown", 1, 1)}
    top = panels.top_products(marts.top_products_daily(fact, marts.present_names(dim)), F.lit("2026-03-07 01:00:00").cast("timestamp"), 7).collect()
    assert [r["product_id"] for r in top] == [1, 9]
    assert panels.top_products(marts.top_products_daily(fact, marts.present_names(dim)), F.lit("2026-03-08 01:00:00").cast("timestamp"), 7).collect() == []
    stock = spark.createDataFrame([(1, 1, q, D, D, 1, 0) for q in (19, 20, -1)], STOCK)
    assert [r["is_low"] for r in marts.inventory_current(stock, marts.present_names(dim)).orderBy("quantity").collect()] == [1, 1, 0]


def test_health_of_empty_tables(spark):
    empty = spark.createDataFrame([], ORDER)
    refreshes = spark.createDataFrame([("m", "Error", None, "")], "name string, status string, last_success_time timestamp, last_error string")
    rows = {r["name"]: r for r in marts.pipeline_health({"stg_orders": (empty, "event_time")}, refreshes).collect()}
    assert rows["stg_orders"]["last_event_time"] is None and rows["m"]["last_error"] is None


@pytest.fixture
def tables(spark):
    old = datetime(2026, 1, 1)
    orders = spark.createDataFrame([order(i, at=old, version=2) for i in range(1, 6)], ORDER)
    items = spark.createDataFrame([item(i, i, at=old) for i in range(1, 6)], ITEM)
    products = spark.createDataFrame([(1, old, "p", "food", Decimal("11.00"), 0, 0, old, 1)], PRODUCT)
    history = spark.createDataFrame([(i, "paid", old, 0, 2) for i in range(1, 6)], HISTORY)
    dim = "{0} long, is_current int"
    fact = marts.fact_orders(items, orders, products)
    return {
        "stg_orders": orders, "stg_order_items": items, "stg_product_versions": products, "stg_order_status_history": history, "stg_inventory": spark.createDataFrame([(1, 1, 5, old, old, 1, 0)], STOCK),
        "fact_orders": fact, "mart_revenue_daily": marts.revenue_daily(fact), "dim_customers": spark.createDataFrame([(1, 1), (1, 0)], dim.format("customer_id")), "dim_products": spark.createDataFrame([(1, 1)], dim.format("product_id")),
    }


def failing(tables):
    got = quality.run(tables, F.lit("2026-02-01").cast("timestamp"))
    return {r["check_name"]: (r["violations"], r["sample_keys"]) for r in got[:-1] if r["status"] != "ok"}, got[-1]


def test_clean_tables_pass(tables):
    assert failing(tables)[0] == {}


FAULTS = {
    "orders_conflicting_versions": ("stg_orders", lambda s: [order(1, "shipped", datetime(2026, 1, 1), version=2)], ORDER, {"status_differs_from_history"}),
    "order_items_conflicting_versions": ("stg_order_items", lambda s: [(1, 1, 1, 3, Decimal("10.00"), datetime(2026, 1, 1), 1, 0)], ITEM, set()),
    "negative_order_items": ("stg_order_items", lambda s: [(9, 1, 1, -1, Decimal("10.00"), datetime(2026, 1, 1), 9, 0)], ITEM, set()),
    "negative_prices": ("stg_product_versions", lambda s: [(1, datetime(2026, 1, 2), "p", "food", Decimal("-1.00"), 0, 0, D, 9)], PRODUCT, set()),
    "negative_inventory": ("stg_inventory", lambda s: [(2, 1, -5, D, D, 1, 0)], STOCK, set()),
    "orphan_order_items": ("stg_order_items", lambda s: [item(99, 99, at=datetime(2026, 1, 1))], ITEM, set()),
    "orders_without_items": ("stg_orders", lambda s: [order(50, at=datetime(2026, 1, 1))], ORDER, set()),
    "status_differs_from_history": ("stg_order_status_history", lambda s: [(1, "shipped", datetime(2026, 1, 2), 0, 9)], HISTORY, set()),
    "history_without_order": ("stg_order_status_history", lambda s: [(70, "paid", datetime(2026, 1, 2), 0, 9)], HISTORY, set()),
    "dim_multiple_current": ("dim_products", lambda s: [(1, 1)], "product_id long, is_current int", set()),
}


@pytest.mark.parametrize("check", FAULTS)
def test_each_fault_fires_its_check(spark, tables, check):
    name, rows, schema, also = FAULTS[check]
    tables[name] = tables[name].unionByName(spark.createDataFrame(rows(spark), schema))
    found = failing(tables)[0]
    assert check in found and set(found) <= {check} | also and found[check][0] == 1


def test_recent_rows_are_left_alone(spark, tables):
    late = datetime(2026, 1, 31, 23, 50)
    tables["stg_order_items"] = tables["stg_order_items"].unionByName(spark.createDataFrame([item(99, 99, at=late)], ITEM))
    assert failing(tables)[0] == {}


def test_broken_check_stops_no_other(tables):
    del tables["stg_inventory"]
    found, total = failing(tables)
    assert set(found) == {"negative_inventory"} and total["status"] == "error"


def test_panel_sentinel(spark):
    res = spark.createDataFrame([("probe", "error", D)], "check_name string, status string, checked_at timestamp")
    assert panels.probe_age(res, "probe", F.lit("2026-03-01 13:01:00").cast("timestamp")).first()["hours"] == 99999
    res = spark.createDataFrame([("probe", "ok", datetime(2026, 3, 1, 0, 59))], "check_name string, status string, checked_at timestamp")
    assert panels.probe_age(res, "probe", F.lit("2026-03-01 01:01:00").cast("timestamp")).first()["hours"] == 1
