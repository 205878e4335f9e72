"""The fact and the marts over it.  ``as_of`` is an argument; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import money, month_index, months_between_firsts, sum_if
from tidemark.operators.asof import MANY_ROWS, asof_left_join, hot_ranges
from tidemark.operators.quantiles import exact_quantiles

UNKNOWN = "unknown"
LOW_STOCK = 20


def hot_products(journal: DataFrame, items: DataFrame, orders: DataFrame, many: int = MANY_ROWS) -> DataFrame | None:
    """Products with so many lines that ``fact_orders`` should spread them; counted in the lines' ``journal``, their times looked at only if there are any."""
    lines = items.select("order_id", "product_id").join(orders.select("order_id", "created_at"), "order_id")
    return hot_ranges(journal.select("product_id"), lines, "product_id", "created_at", many)


def order_lines(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Live lines of live orders; ``event_time`` is the later of both."""
    o = orders.select("order_id", "customer_id", "status", "created_at", F.col("event_time").alias("_order_time"))
    lines = items.select("order_item_id", "order_id", "product_id", "quantity", "price_at_order", "event_time").join(o, "order_id")
    return lines.withColumn("event_time", F.greatest("event_time", "_order_time")).drop("_order_time")


def fact_orders(items: DataFrame, orders: DataFrame, dim_products: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Live lines of live orders with the product version valid when the order was made.

    ``items`` and ``orders`` are live views, ``dim_products`` the dimension: a
    product first seen in a snapshot has been valid since the epoch.  The last
    version goes on after its end.  ``hot`` (of ``hot_products``) names products
    to be spread over tasks.
    """
    lines = order_lines(items, orders)
    p = dim_products.select("product_id", "valid_from", "category", F.col("price").alias("list_price"))
    facts = asof_left_join(lines, p, "product_id", "created_at", "valid_from", ["category", "list_price"], hot)
    return facts.select(
        "order_item_id", "order_id", "customer_id", "product_id", "status", "created_at", "quantity", "price_at_order", "category", "list_price",
        F.to_date("created_at").alias("order_date"),
        money(F.col("quantity") * F.col("price_at_order"), 18).alias("amount"),
        "event_time",
    )


def _watermark(df: DataFrame, column: str = "event_time") -> DataFrame:
    """The newest event behind a table, one row to cross join (no window without partitions)."""
    return df.agg(F.max(column).alias("source_watermark"))


def _with_watermark(grouped: DataFrame) -> DataFrame:
    """Groups that carry their own newest event, with that of all in its place.

    The maximum is taken of the groups, not in a second pass over what they
    were made of.  It is that of whole groups, and the groups' own newest event
    goes into ``source_watermark`` (which is never before it), so no column is
    pruned on either side and both read one shuffle.
    """
    names = [c for c in grouped.columns if c != "_newest"]
    last = F.max(F.struct("_newest", *names))
    both = grouped.crossJoin(F.broadcast(grouped.agg(last["_newest"].alias("_last"))))
    return both.select(*names, F.greatest("_last", "_newest").alias("source_watermark"))


def revenue_sums(fact: DataFrame) -> DataFrame:
    """Per day and category; ``orders`` is not additive over categories; net leaves out cancelled orders only.

    One line of each order, day and category is marked and marks are counted:
    nearly every line is alone there, so sums by order would save nothing.
    """
    rows = fact.withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))
    mine = Window.partitionBy("order_id", "order_date", "category").orderBy("order_id")
    return rows.withColumn("_n", F.row_number().over(mine)).groupBy("order_date", "category").agg(
        F.count_if((F.col("_n") == 1) & F.col("order_id").isNotNull()).alias("orders"),
        F.sum("quantity").cast("bigint").alias("items"),
        money(F.sum("amount")).alias("revenue"),
        money(sum_if(F.col("status") != "cancelled", F.col("amount"))).alias("revenue_net"),
        F.max("event_time").alias("_newest"),
    )


def revenue_daily(fact: DataFrame) -> DataFrame:
    return _with_watermark(revenue_sums(fact))


def order_levels(orders: DataFrame, history: DataFrame) -> DataFrame:
    """Per order: how far up the ladder it ever was, and when it first got to each step (snapshots tell no time)."""
    level = F.when(F.col("status") == "delivered", 3).when(F.col("status") == "shipped", 2).when(F.col("status") == "paid", 1).otherwise(0)
    seen = F.col("is_snapshot") == 0
    times = {s: F.min(F.when(seen & (F.col("status") == s), F.col("changed_at"))).alias(f"{s}_at") for s in ("paid", "shipped", "delivered")}
    past = history.groupBy("order_id").agg(
        F.max(level).alias("past_level"),
        F.max((F.col("status") == "cancelled").cast("int")).alias("was_cancelled"),
        *times.values(),
    )
    rows = orders.select("order_id", "status", "created_at", "event_time", level.alias("level")).join(past, "order_id", "left")
    return rows.select(
        "order_id", "created_at", "event_time", "paid_at", "shipped_at", "delivered_at",
        F.greatest("level", F.coalesce("past_level", F.lit(0))).alias("level"),
        ((F.col("status") == "cancelled") | (F.coalesce("was_cancelled", F.lit(0)) == 1)).alias("cancelled"),
    )


BUSY_DAY = 200_000  # orders a day up to which the durations of a day are sorted in one buffer


def funnel_daily(orders: DataFrame, history: DataFrame, journal: DataFrame | None = None, busy: int = BUSY_DAY) -> DataFrame:
    """Orders by day and how many of them ever got to each step; seconds between steps, null where none is known.

    Quantiles are exact.  If some day has more than ``busy`` rows in
    ``journal`` (all rows of orders; by default the live ones), they are found
    by bins (``exact_quantiles``), which hold no day's values together.
    """
    rows = order_levels(orders, history).withColumn("order_date", F.to_date("created_at"))

    def millis(a: str, b: str) -> Column:
        return F.unix_millis(b) - F.unix_millis(a)

    steps = {"to_paid": millis("created_at", "paid_at"), "to_delivered": millis("created_at", "delivered_at")}
    shares = {"median": 0.5, "p90": 0.9}
    days = (orders if journal is None else journal).groupBy(F.to_date("created_at")).count()
    few = (days.agg(F.max("count").alias("n")).first()["n"] or 0) <= busy
    counted = rows.groupBy("order_date").agg(
        F.count("*").alias("created"),
        F.count_if(F.col("level") >= 1).alias("paid"),
        F.count_if(F.col("level") >= 2).alias("shipped"),
        F.count_if(F.col("level") >= 3).alias("delivered"),
        F.count_if("cancelled").alias("cancelled"),
        *[F.percentile(took / 1000.0, F.lit(share)).alias(f"{name}_{step}") for step, took in steps.items() for name, share in shares.items() if few],
        F.max("event_time").alias("_newest"),
    )
    if few:
        return _with_watermark(counted)
    took = exact_quantiles(rows, ["order_date"], steps, tuple(shares.values()))
    named = [(F.col(f"`{step}_{share}`") / 1000.0).alias(f"{name}_{step}") for step in steps for name, share in shares.items()]
    return _with_watermark(counted).join(took.select("order_date", *named), "order_date", "left")


def cohort_orders(orders: DataFrame, as_of: Column) -> DataFrame:
    """Orders that count for cohorts: neither cancelled nor of the future."""
    return orders.where((F.col("status") != "cancelled") & (F.col("created_at") <= as_of))


def cohort_retention(orders: DataFrame, as_of: Column, all_rows: DataFrame | None = None) -> DataFrame:
    """Customers by month of first order, and how many came back in each later month up to now.

    ``orders`` is the live view; cancelled and future orders don't count; the
    current month of every cohort is partial.  ``all_rows`` gives the
    watermark, over every physical row.
    """
    rows = cohort_orders(orders, as_of)
    active = rows.select("customer_id", F.trunc("created_at", "MM").alias("month")).distinct()
    active = active.withColumn("cohort_month", F.min("month").over(Window.partitionBy("customer_id")))
    active = active.withColumn("period", months_between_firsts(F.col("cohort_month"), F.col("month")))
    came = active.groupBy("cohort_month", "period").agg(F.count("*").alias("returned"))
    sizes = came.where("period = 0").select("cohort_month", F.col("returned").alias("customers"))
    age = (month_index(as_of) - month_index(F.col("cohort_month"))).cast("int")
    grid = sizes.withColumn("age", age).where("age >= 0").withColumn("period", F.explode(F.sequence(F.lit(0), F.col("age"))))
    out = grid.join(came, ["cohort_month", "period"], "left")
    return out.select(
        "cohort_month", F.col("period").cast("int").alias("period"), "customers", F.coalesce("returned", F.lit(0)).alias("returned"), (F.col("period") == F.col("age")).cast("int").alias("is_partial")
    ).crossJoin(F.broadcast(_watermark(all_rows if all_rows is not None else orders)))


def present_names(dim_products: DataFrame) -> DataFrame:
    """``product_id, name, category`` of the current version of each product."""
    best = dim_products.where("is_current = 1").groupBy("product_id").agg(F.max_by(F.struct("name", "category"), "version").alias("p"))
    return best.select("product_id", "p.name", "p.category")


def newest_names(versions: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """The same from the journal itself, without building the history: the newest version, unless that is a delete."""
    best = versions.groupBy("product_id").agg(F.max_by(F.struct("name", "category", "is_deleted"), F.struct("version", "valid_from", *tie)).alias("p"))
    return best.where("p.is_deleted = 0").select("product_id", "p.name", "p.category")


def top_products_daily(fact: DataFrame, names: DataFrame) -> DataFrame:
    """Sales per day, product and the category it then had, with its present name (of ``names(product_id, name)``)."""
    rows = fact.withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))
    net = F.col("status") != "cancelled"
    sold = rows.groupBy("order_date", "product_id", "category").agg(
        F.sum("quantity").cast("bigint").alias("quantity"),
        sum_if(net, F.col("quantity")).cast("bigint").alias("quantity_net"),
        money(F.sum("amount")).alias("revenue"),
        money(sum_if(net, F.col("amount"))).alias("revenue_net"),
        F.max("event_time").alias("_newest"),
    )
    named = names.select("product_id", F.col("name").alias("product_name"))
    return _with_watermark(sold).join(named, "product_id", "left").withColumn("product_name", F.coalesce("product_name", F.lit(UNKNOWN)))


def inventory_current(stock: DataFrame, names: DataFrame) -> DataFrame:
    """Stock by product and warehouse with the product's present name and category; under ``LOW_STOCK`` it is low."""
    named = names.select("product_id", F.col("name").alias("_name"), F.col("category").alias("_category"))
    out = stock.join(named, "product_id", "left").select(
        "product_id", "warehouse_id", F.coalesce("_name", F.lit(UNKNOWN)).alias("product_name"), F.coalesce("_category", F.lit(UNKNOWN)).alias("category"),
        "quantity", (F.col("quantity") < LOW_STOCK).cast("int").alias("is_low"), "updated_at",
    )
    return out.crossJoin(F.broadcast(_watermark(stock)))


def watermarks(items: DataFrame, orders: DataFrame, all_orders: DataFrame, stock: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """By mart: one row with its ``source_watermark``, null for a mart without rows, told of all rows that go into it.

    ``items``, ``orders`` and ``stock`` are live views.  What lines, orders and
    stock meet on their way into a mart (versions, histories, names) is joined
    from the left and unique by its key, and groups keep the newest event of
    their rows: so it is known without pricing a line or making a group.
    """
    sold = _watermark(order_lines(items, orders))
    counted = cohort_orders(orders, as_of).agg((F.count("*") > 0).alias("_any"))
    cohorts = _watermark(all_orders).crossJoin(F.broadcast(counted)).select(F.when(F.col("_any"), F.col("source_watermark")).alias("source_watermark"))
    return {"revenue_daily": sold, "funnel_daily": _watermark(orders), "cohort_retention": cohorts, "top_products_daily": sold, "inventory_current": _watermark(stock)}


def pipeline_health(sources: dict[str, tuple[DataFrame, str]], refreshes: DataFrame) -> DataFrame:
    """The newest event of each source (null for an empty one) and the state of each refresh."""
    out = refreshes.select(F.lit("view").alias("kind"), "name", F.lit(None).cast("timestamp").alias("last_event_time"), "status", "last_success_time", F.nullif("last_error", F.lit("")).alias("last_error"))
    for name, (df, time) in sources.items():
        none = F.lit(None)
        row = df.agg(F.max(time).alias("last_event_time")).select(F.lit("source").alias("kind"), F.lit(name).alias("name"), "last_event_time", none.cast("string").alias("status"), none.cast("timestamp").alias("last_success_time"), none.cast("string").alias("last_error"))
        out = out.unionByName(row)
    return out
