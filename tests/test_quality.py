"""All checks in one plan against each check alone; checks as files; quantiles of busy days."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import marts, queries

D = datetime(2026, 1, 1)
SCHEMAS = {
    "stg_orders": "order_id long, customer_id long, status string, created_at timestamp, updated_at timestamp, event_time timestamp, version long, is_deleted int",
    "stg_order_items": "order_item_id long, order_id long, product_id long, quantity int, price_at_order decimal(10,2), event_time timestamp, version long, is_deleted int",
    "stg_order_status_history": "order_id long, status string, changed_at timestamp, is_snapshot int, version long",
    "stg_product_versions": "product_id long, valid_from timestamp, name string, category string, price decimal(10,2), is_snapshot int, is_deleted int, event_time timestamp, version long",
    "stg_inventory": "product_id long, warehouse_id int, quantity int, updated_at timestamp, event_time timestamp, version long, is_deleted int",
    "fact_orders": "order_item_id long, order_date date, category string, amount decimal(18,2)",
    "mart_revenue_daily": "order_date date, category string, revenue decimal(18,2), revenue_net decimal(18,2)",
    "dim_customers": "customer_id long, is_current int",
    "dim_products": "product_id long, is_current int",
}


def made(seed, n=60):
    """Tables in which every check finds something, with repeated rows, ties, nulls and recent rows."""
    rng = random.Random(seed)
    at = lambda: D + timedelta(days=rng.choice([0, 1, 2, 31]), minutes=rng.randrange(1440))
    states = ["created", "paid", "shipped"]
    few = lambda: rng.choice([None, *range(n // 2)])
    rows = {
        "stg_orders": [(few(), rng.randrange(3), rng.choice(states), at(), D, at(), rng.randrange(3), rng.choice([0, 0, 0, 1])) for _ in range(n)],
        "stg_order_items": [(rng.randrange(n), few(), 1, rng.choice([-1, 0, 1, 2]), Decimal(rng.choice([-1, 5, 5])), at(), rng.randrange(3), rng.choice([0, 0, 0, 1])) for _ in range(n)],
        "stg_order_status_history": [(few(), rng.choice(states), at(), 0, i) for i in range(n)],
        "stg_product_versions": [(rng.randrange(9), at(), "p", "c", Decimal(rng.choice([-2, 3])), 0, rng.choice([0, 0, 1]), D, i) for i in range(n)],
        "stg_inventory": [(rng.randrange(5), rng.randrange(3), rng.choice([-3, 4]), D, D, rng.randrange(9), 0) for _ in range(n)],
        "fact_orders": [(rng.randrange(n), D.date(), "c", Decimal(1)) for _ in range(n)],
        "mart_revenue_daily": [((D + timedelta(days=i)).date(), "c", Decimal(rng.choice([-1, 1])), Decimal(1)) for i in range(9)],
        "dim_customers": [(rng.randrange(20), 1) for _ in range(20)],
        "dim_products": [(i, rng.choice([0, 1])) for i in range(20)],
    }
    return {k: v + v[:5] for k, v in rows.items()}


@pytest.fixture
def tables(spark):
    return lambda rows: {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def as_of():
    return F.lit("2026-02-01 12:00:00").cast("timestamp")


def told(rows):
    return {r["check_name"]: (r["table_name"], r["violations"], list(r["sample_keys"])) for r in rows}


def alone(tables):
    return told(quality.summary(c.name, c.table, c.find(tables, as_of())).first().asDict() for c in quality.CHECKS)


@pytest.mark.parametrize("seed", range(3))
def test_one_plan_finds_what_each_check_finds(tables, seed):
    t = tables(made(seed))
    got = told(quality.together(t, as_of()).collect())
    assert got == alone(t)
    assert sum(v[1] > 0 for v in got.values()) >= 10


def test_empty_tables_violate_nothing(tables):
    got = told(quality.together(tables({}), as_of()).collect())
    assert len(got) == 12 and all(v[1:] == (0, []) for v in got.values())


def test_each_table_is_read_once(spark, tables, tmp_path):
    for n, df in tables(made(1)).items():
        df.write.parquet(f"{tmp_path}/{n}")
    stored = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in SCHEMAS}
    saved = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan shows what is used again
        plan = quality.together(stored, as_of())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", saved)
    assert plan.count("FileScan parquet") == len(SCHEMAS), plan


def test_only_a_broken_plan_is_taken_apart(tables, monkeypatch):
    t = tables(made(2))
    calls = []
    monkeypatch.setattr(quality, "summary", lambda *a, real=quality.summary: calls.append(a[0]) or real(*a))
    whole = told(quality.run(t, as_of())[:-1])
    assert calls == []
    del t["stg_inventory"]
    got = quality.run(t, as_of())
    assert {r["check_name"] for r in got[:-1] if r["status"] == "error"} == {"negative_inventory"} and got[-1]["status"] == "error"
    assert {n: v for n, v in told(got[:-1]).items() if n != "negative_inventory"} == {n: v for n, v in whole.items() if n != "negative_inventory"}


def test_a_new_check_needs_a_file_only(tables, tmp_path):
    (tmp_path / "02_named_so.sql").write_text("-- table: stg_orders\n-- hint: first line\n-- hint: second line\nSELECT order_id AS sample_key FROM {stg_orders} WHERE event_time < :as_of AND order_id IS NOT NULL GROUP BY order_id\n")
    (tmp_path / "10_broken.sql").write_text("-- table: stg_orders\nSELEC nothing FROM {stg_orders}\n")
    (tmp_path / "11_no_head.sql").write_text("SELECT 1 AS sample_key FROM {stg_orders}\n")
    (tmp_path / "12_unknown_table.sql").write_text("-- table: x\nSELECT 1 AS sample_key FROM {x}\n")
    (tmp_path / "9_none.sql").write_text("-- table: stg_orders\n-- hint: nothing is found\nSELECT order_id AS sample_key FROM {stg_orders} WHERE false\n")
    (tmp_path / "notes.sql").write_text("no number, no check")
    checks = quality.catalogue(tmp_path)
    assert [c.name for c in checks] == ["named_so", "none", "broken", "no_head", "unknown_table"]
    assert (checks[0].table, checks[0].hint) == ("stg_orders", "first line second line")
    rows = made(3)
    got = {r["check_name"]: r for r in quality.run(tables(rows), as_of(), checks)}
    keys = {str(r[0]) for r in rows["stg_orders"] if r[0] is not None and r[5] < datetime(2026, 2, 1, 12)}
    assert (got["named_so"]["violations"], got["named_so"]["sample_keys"]) == (len(keys), sorted(keys)[:10])
    assert [got[n]["status"] for n in ("none", "broken", "no_head", "unknown_table", "summary")] == ["ok", "error", "error", "error", "error"]
    both = quality.run(tables(rows), as_of(), (*quality.CHECKS[:2], checks[0]))
    assert [r["check_name"] for r in both] == ["fact_duplicate_items", "orders_conflicting_versions", "named_so", "summary"]


def test_the_shipped_files_are_whole():
    checks = quality.catalogue(queries.CATALOGUE)
    assert len(checks) == 3 and all(c.table in SCHEMAS and c.hint for c in checks)


def test_busy_days_have_the_same_quantiles(spark):
    rng = random.Random(5)
    orders = [(i, 1, "delivered", D + timedelta(days=i % 3, seconds=rng.randrange(80_000)), D, D, 1, 0) for i in range(90)] + [(900, 1, "created", D + timedelta(days=9), D, D, 1, 0)]
    history = [(o[0], s, o[3] + timedelta(milliseconds=rng.randrange(10**8)), 0, v) for o in orders[:-1] for v, s in enumerate(("paid", "delivered")) if rng.random() < 0.9]
    o, h = spark.createDataFrame(orders, SCHEMAS["stg_orders"]), spark.createDataFrame(history, SCHEMAS["stg_order_status_history"])
    few, many = ({r["order_date"]: r.asDict() for r in marts.funnel_daily(o, h, busy=n).collect()} for n in (1000, 10))
    assert few.keys() == many.keys() and len(few) == 4
    for day, want in few.items():
        assert many[day] == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()}
