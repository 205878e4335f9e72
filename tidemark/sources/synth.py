"""Operational tables and change messages derived from the driver tables.

Everything is arithmetic over keys, so the same rows come out in any engine:
states follow ``o_orderkey % 5``, times follow order days, and repeated
``(l_orderkey, l_linenumber)`` pairs stand for several versions of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CUSTOMERS, INVENTORY, ORDER_ITEMS, PRODUCTS, Feed
from .tables import table

STATES = ("created", "paid", "shipped", "delivered", "cancelled")
AS_OF = "2001-09-01 00:00:00"
EVENTS_AS_OF = "2024-02-05 00:00:00"
ITEM_ORDER = ("version", "product_id", "quantity", "price_at_order", "event_time", "is_deleted")


def state_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), (key % 5 + 1).cast("int"))


def stg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    made = F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") * 37 % 86_400) * 1_000_000)
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), state_of(F.col("o_orderkey")).alias("status"), made.alias("created_at"),
        made.alias("updated_at"), made.alias("event_time"), (F.col("o_orderkey") * 2 + 1).alias("version"), (F.col("o_orderkey") % 97 == 0).cast("int").alias("is_deleted"),
    )


def stg_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(10,2)").alias("price_at_order"), F.col("l_shipdate").alias("event_time"),
        F.col("l_suppkey").cast("bigint").alias("version"), (F.col("l_returnflag") == "R").cast("int").alias("is_deleted"),
    )


def stg_product_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("valid_from"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("c"), ((F.col("l_partkey") + F.col("l_suppkey") % 3) % 5).cast("string")).alias("category"),
        (10 + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 50).cast("decimal(10,2)").alias("price"),
        (F.col("l_orderkey") % 50 == 0).cast("int").alias("is_snapshot"), F.lit(0).alias("is_deleted"), F.col("l_shipdate").alias("event_time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"),
    )


PRODUCT_TIE = ("category", "price", "is_snapshot")


def stg_status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder up to an order's state, one step every ``1 + order % 7`` hours; every 13th order has none."""
    o = stg_orders(spark, sf_dir).where(F.col("order_id") % 13 != 0)
    top = F.when(F.col("order_id") % 5 == 4, F.array(F.lit(0), F.lit(4))).otherwise(F.sequence(F.lit(0), (F.col("order_id") % 5).cast("int")))
    steps = o.select("order_id", "created_at", F.posexplode(top).alias("pos", "step"))
    return steps.select(
        "order_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("step") + 1).alias("status"),
        F.timestamp_micros(F.unix_micros("created_at") + F.col("pos") * (1 + F.col("order_id") % 7) * 3_600_000_000).alias("changed_at"),
        (F.col("order_id") % 29 == 0).cast("int").alias("is_snapshot"), (F.col("order_id") * 10 + F.col("pos")).alias("version"),
    )


def dealt(df: DataFrame, key: str, a_task: int = 100_000) -> DataFrame:
    """Rows of a narrow table dealt over tasks of some ``a_task``: its few splits would each hold all that is made of their rows."""
    tasks = df.count() // a_task
    return df.repartition(tasks, key) if tasks > 1 else df


def stg_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three warehouses a part, two versions each; the constant list is the small side."""
    p = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").withColumn("warehouse_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    p = p.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    at = F.timestamp_seconds(F.lit(978_307_200) + F.col("p_partkey") % 1000 * 60 + F.col("v") * 3600)
    return p.select(
        F.col("p_partkey").alias("product_id"), "warehouse_id", ((F.col("p_partkey") * 7 + F.col("warehouse_id") * 13 + F.col("v") * 5) % 201 - 1).cast("int").alias("quantity"),
        at.alias("updated_at"), at.alias("event_time"), F.col("v").cast("bigint").alias("version"),
        ((F.col("p_partkey") % 41 == 0) & (F.col("v") == 2)).cast("int").alias("is_deleted"),
    )


def user_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal of users: the type is the attribute, an error deletes, every 50th row is a snapshot."""
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").alias("valid_from"), F.col("event_type").alias("state"), (F.col("event_id") % 50 == 0).cast("int").alias("is_snapshot"),
        (F.col("event_type") == "error").cast("int").alias("is_deleted"), F.col("event_id").alias("version"),
    )


def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of check runs."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("ok", "violation", "lagging", "source_unavailable", "error")]), (F.col("event_id") % 5 + 1).cast("int"))
    run = F.concat(F.when(F.col("event_id") % 3 == 0, "manual__").otherwise("scheduled__"), F.date_format("ts", "yyyy-MM-dd"))
    name = F.when(F.col("event_id") % 7 == 0, "summary").when(F.col("event_id") % 7 == 1, "table_size").otherwise(F.concat(F.lit("check_"), (F.col("event_id") % 7).cast("string")))
    return e.select(
        F.concat(F.lit("job_"), (F.col("user_id") % 4).cast("string")).alias("dag_id"), run.alias("run_id"), name.alias("check_name"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("table_name"), status.alias("status"), F.col("ts").alias("checked_at"), F.col("event_id").alias("ch_value"), F.col("props").alias("details"),
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kafka-shaped change messages of orders, two an order; every 11th order has a planted fault in the second.

    Faults go by ``order % 55``: 0 a negative customer, 11 no image, 22 no
    state, 33 a broken time, 44 a broken key.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), "o_orderdate", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    fault = F.when((F.col("n") == 1) & (F.col("id") % 11 == 0), F.col("id") % 55).otherwise(F.lit(-1))
    o = o.withColumn("fault", fault)
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000000Z"))
    status = F.when(F.col("n") == 0, "created").otherwise(state_of(F.col("id")))
    after = F.struct(
        F.col("id").alias("order_id"), F.when(F.col("fault") == 0, -1).otherwise(F.col("cust")).alias("customer_id"), F.when(F.col("fault") == 22, None).otherwise(status).alias("status"),
        F.when(F.col("fault") == 33, "soon").otherwise(iso).alias("created_at"), iso.alias("updated_at"),
    )
    before = F.when(F.col("n") == 1, F.struct(F.col("id").alias("order_id"), F.lit("created").alias("status")))
    body = F.to_json(F.struct(
        before.alias("before"), F.when(F.col("fault") == 11, None).otherwise(after).alias("after"), F.when(F.col("n") == 0, "c").otherwise("u").alias("op"),
        F.struct((F.col("id") * 2 + F.col("n")).alias("lsn"), (F.unix_millis("o_orderdate") + F.col("n") * 60_000).alias("ts_ms"), (F.unix_micros("o_orderdate") + F.col("n") * 60_000_000).alias("ts_us")).alias("source"),
    ))
    key = F.when(F.col("fault") == 44, F.lit('{"order_id": "x"}')).otherwise(F.to_json(F.struct(F.col("id").alias("order_id"))))
    return o.select(key.cast("binary").alias("key"), body.cast("binary").alias("value"), F.lit("cdc.public.orders").alias("topic"), F.lit(0).alias("partition"), (F.col("id") * 2 + F.col("n")).alias("offset"))


def bench_tables(spark: SparkSession, n_orders: int) -> dict[str, DataFrame]:
    """Tables of the published workload's shape: three lines an order over 14 days, 20,000 product versions, 150,000 customer versions."""
    start = 1_767_225_600
    ids = spark.range(n_orders)
    made = F.timestamp_micros(F.lit(start * 1_000_000) + F.col("id") * (14 * 86_400 * 1_000_000 // max(n_orders, 1)))
    orders = ids.select(F.col("id").alias("order_id"), (F.col("id") % 50_000).alias("customer_id"), state_of(F.col("id")).alias("status"), made.alias("created_at"), made.alias("event_time"), (F.col("id") + 1).alias("version"), F.lit(0).alias("is_deleted"))
    items = spark.range(3 * n_orders).select(
        F.col("id").alias("order_item_id"), F.floor(F.col("id") / 3).alias("order_id"), (F.xxhash64("id") % 2000 + 2000).alias("h"), (F.col("id") % 5 + 1).cast("int").alias("quantity"),
        (F.col("id") % 90 + 10).cast("decimal(10,2)").alias("price_at_order"), F.timestamp_seconds(F.lit(start) + F.col("id") % 86_400).alias("event_time"), (F.col("id") + 1).alias("version"), F.lit(0).alias("is_deleted"),
    ).withColumn("product_id", F.col("h") % 2000).drop("h")
    products = spark.range(20_000).select(
        (F.col("id") % 2000).alias("product_id"), F.timestamp_seconds(F.lit(start) - 86_400 + F.floor(F.col("id") / 2000) * 100_000).alias("valid_from"), F.concat(F.lit("p"), F.col("id") % 2000).alias("name"),
        F.concat(F.lit("c"), F.col("id") % 20).alias("category"), (F.col("id") % 90 + 10 + F.floor(F.col("id") / 2000)).cast("decimal(10,2)").alias("price"), F.lit(0).alias("is_snapshot"), F.lit(0).alias("is_deleted"),
        F.timestamp_seconds(F.lit(start)).alias("event_time"), (F.col("id") + 1).alias("version"),
    )
    customers = spark.range(150_000).select(
        (F.col("id") % 50_000).alias("customer_id"), F.timestamp_seconds(F.lit(start) + F.floor(F.col("id") / 50_000) * 86_400).alias("valid_from"), F.concat(F.lit("n"), F.col("id") % 50_000).alias("name"),
        F.concat(F.lit("a"), F.col("id")).alias("address"), F.concat(F.lit("s"), F.col("id") % 3).alias("segment"), F.lit(0).alias("is_snapshot"), F.lit(0).alias("is_deleted"), (F.col("id") + 1).alias("version"),
    )
    steps = F.when(F.col("order_id") % 5 == 4, F.array(F.lit(0), F.lit(4))).otherwise(F.sequence(F.lit(0), (F.col("order_id") % 5).cast("int")))
    history = orders.select("order_id", "created_at", F.posexplode(steps).alias("pos", "step")).select(
        "order_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("step") + 1).alias("status"), F.timestamp_seconds(F.unix_seconds("created_at") + F.col("pos") * 3600).alias("changed_at"),
        F.lit(0).alias("is_snapshot"), (F.col("order_id") * 10 + F.col("pos")).alias("version"),
    )
    stock = spark.range(6000).select((F.col("id") % 2000).alias("product_id"), (F.floor(F.col("id") / 2000) + 1).cast("int").alias("warehouse_id"), (F.col("id") * 7 % 200).cast("int").alias("quantity"), F.timestamp_seconds(F.lit(start)).alias("updated_at"), F.timestamp_seconds(F.lit(start)).alias("event_time"), F.lit(1).alias("version"), F.lit(0).alias("is_deleted"))
    return {"orders": orders, "items": items, "products": products, "customers": customers, "history": history, "stock": stock}


# --- change messages of all five feeds -----------------------------------------------------


def messages_of(rows: DataFrame, feed: Feed, before: Column, after: Column, op: Column, lsn: Column, millis: Column) -> DataFrame:
    """Kafka-shaped messages of one feed; ``rows`` hold the key's columns, images may be null."""
    body = F.to_json(F.struct(before.alias("before"), after.alias("after"), op.alias("op"), F.struct(lsn.alias("lsn"), millis.alias("ts_ms"), (millis * 1000 + 7).alias("ts_us")).alias("source")))
    key = F.to_json(F.struct(*[F.col(n) for n in feed.key]))
    return rows.select(key.cast("binary").alias("key"), body.cast("binary").alias("value"), F.lit(feed.topic).alias("topic"), F.lit(0).alias("partition"), lsn.alias("offset"))


def _image(*cols: Column) -> Column:
    return F.struct(*cols)


def item_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines: ``(order + line) % 4`` says insert, update, delete or snapshot; every third order's deletes lack their image, every fifth's have a negative product."""
    li = table(spark, sf_dir, "lineitem").withColumn("order_item_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    op = F.element_at(F.array(*map(F.lit, "cudr")), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 + 1).cast("int"))
    product = F.when((op == "d") & (F.col("l_orderkey") % 5 == 0), -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    image = _image(F.col("l_orderkey").alias("order_id"), product.alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(10,2)").cast("string").alias("price_at_order"))
    before = F.when((op == "d") & (F.col("l_orderkey") % 3 != 0), image)
    return messages_of(li, ORDER_ITEMS, before, F.when(op != "d", image), op, F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100, F.unix_millis("l_shipdate"))


def customer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: a snapshot of each, an update of every second one, a delete of every seventh; no address anywhere."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name", "c_mktsegment", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    c = c.where("n = 0 OR (n = 1 AND customer_id % 2 = 0) OR (n = 2 AND customer_id % 7 = 0)")
    op = F.element_at(F.array(*map(F.lit, "rud")), F.col("n") + 1)
    image = _image(F.col("c_name").alias("name"), F.when(F.col("n") == 0, F.col("c_mktsegment")).alias("segment"))
    lsn = F.col("customer_id") * 10 + F.col("n")
    return messages_of(c, CUSTOMERS, F.when(op == "d", image), F.when(op != "d", image), op, lsn, F.lit(1_000_000_000_000) + lsn * 60_000)


def product_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products: a snapshot and an update to a price that every 11th one spells wrong."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_name", "p_brand", "p_retailprice", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    price = F.when((F.col("n") == 1) & (F.col("product_id") % 11 == 0), "cheap").otherwise((F.col("p_retailprice").cast("decimal(10,2)") + F.col("n")).cast("decimal(10,2)").cast("string"))
    image = _image(F.col("p_name").alias("name"), F.col("p_brand").alias("category"), price.alias("price"))
    lsn = F.col("product_id") * 10 + F.col("n")
    return messages_of(p, PRODUCTS, F.lit(None), image, F.when(F.col("n") == 0, "r").otherwise("u"), lsn, F.lit(1_000_000_000_000) + lsn * 60_000)


def stock_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelves in three warehouses; every 13th part's third one has a number no 32 bits hold."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.explode(F.array(*[F.lit(w).cast("bigint") for w in (1, 2, 3)])).alias("warehouse_id"))
    far = (F.col("product_id") % 13 == 0) & (F.col("warehouse_id") == 3)
    p = p.withColumn("shelf", F.col("product_id") * 4 + F.col("warehouse_id")).withColumn("warehouse_id", F.when(far, F.lit(2**31)).otherwise(F.col("warehouse_id")))
    image = _image((F.col("shelf") % 300 - 20).alias("quantity"), F.lit("2026-01-01T00:00:00.5Z").alias("updated_at"))
    return messages_of(p, INVENTORY, F.lit(None), image, F.lit("u"), F.col("shelf"), F.lit(1_000_000_000_000) + F.col("shelf"))


def broken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of orders with a break of the contract, each kind at its own remainder of the offset by 1009."""
    value = F.col("value").cast("string")
    at = F.col("offset") % 1009
    bent = (
        F.when(at == 0, F.lit("not json")).when(at == 1, F.lit(None)).when(at == 2, F.replace(value, F.lit('"lsn":'), F.lit('"lsn":-'))).when(at == 3, F.regexp_replace(value, '"op":"."', '"op":null'))
        .when(at == 4, F.replace(value, F.lit('"lsn":'), F.lit('"lsx":'))).when(at == 5, F.replace(value, F.lit('"ts_ms":'), F.lit('"ts_mx":'))).otherwise(value)
    )
    return order_messages(spark, sf_dir).withColumn("value", bent.cast("binary"))


# --- both sides of the five tables ---------------------------------------------------------


def _customers(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.lit(None).cast("string").alias("address"), F.timestamp_seconds(F.lit(978_307_200) + F.col("c_custkey")).alias("updated_at"))


def _products(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"), F.timestamp_seconds(F.lit(978_307_200) + F.col("p_partkey")).alias("updated_at"))


def _stock(s: SparkSession, d: str) -> DataFrame:
    i = stg_inventory(s, d).where("version = 1")
    return i.select("product_id", "warehouse_id", "quantity", "updated_at")


def _lines(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("product_id"), F.max("l_quantity").cast("int").alias("quantity"), F.max(F.col("l_extendedprice").cast("decimal(10,2)")).alias("price_at_order"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"), F.col("l_orderkey").alias("order_id"), "product_id", "quantity", "price_at_order")


def source_and_staging(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The operational tables, and staging tables that lack, add and change a few of their rows.

    By the first column of the key: staging lacks every 499th row and has changed
    every 501st, the source lacks every 503rd.
    """
    at = F.timestamp_seconds(F.lit(978_307_200))
    orders = stg_orders(s, d).select("order_id", "customer_id", "status", "created_at", "updated_at")
    tables = {"customers": _customers(s, d), "products": _products(s, d), "orders": orders, "order_items": _lines(s, d), "inventory": _stock(s, d)}
    keys = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "inventory": "product_id"}
    bent = {"customers": ("name", F.concat("name", F.lit("!"))), "products": ("price", F.col("price") + F.lit("0.01").cast("decimal(10,2)")), "orders": ("status", F.lit("lost")), "order_items": ("quantity", F.col("quantity") + 1), "inventory": ("quantity", F.col("quantity") + 1)}
    targets = {"customers": "stg_customer_versions", "products": "stg_product_versions", "orders": "stg_orders", "order_items": "stg_order_items", "inventory": "stg_inventory"}
    source, staging = {}, {}
    for name, df in tables.items():
        k = F.col(keys[name])
        source[name] = df.where(k % 503 != 5)
        column, other = bent[name]
        rows = df.where(k % 499 != 3).withColumn(column, F.when(k % 501 == 7, other).otherwise(F.col(column)).cast(df.schema[column].dataType))
        rows = rows.withColumns({"version": F.lit(1).cast("bigint"), "is_deleted": F.lit(0)})
        if name in ("customers", "products"):
            rows = rows.drop("updated_at").withColumn("valid_from", at)
        if name == "customers":
            rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("address", "segment")})
        staging[targets[name]] = rows
    return source, staging
