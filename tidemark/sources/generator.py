"""A load of shop actions, made as frames.

Everything random is a hash of the row's own key and a seed, so a load is the
same on any cluster, any number of tasks and after any retry; nothing is drawn
row by row.  A load is a frame of actions in time (a Poisson process thinned by
the hour of day); each kind of action turns its rows and the tables they touch
into the rows that the shop would write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Shares of the actions, load by the shop's hour of day, steps of an order.
ACTIONS = {"new_order": 0.40, "advance_order": 0.43, "update_customer": 0.08, "new_customer": 0.04, "update_product": 0.025, "new_product": 0.005, "restock": 0.02}
HOURLY = (0.2, 0.1, 0.1, 0.1, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.0, 1.1, 1.2, 1.1, 1.0, 1.0, 1.1, 1.3, 1.6, 1.8, 1.7, 1.3, 0.8, 0.4)
SHOP_HOURS_AHEAD = 3
STEPS = {"created": {"paid": 0.85, "cancelled": 0.15}, "paid": {"shipped": 0.95, "cancelled": 0.05}, "shipped": {"delivered": 1.0}}
WAREHOUSES = (1, 2, 3)
SEGMENTS = ("new", "regular", "vip", "churn_risk")
CATEGORIES = ("books", "electronics", "home", "toys", "sports")
LEAST_PRICE, MOST_PRICE = 1, 99_999_999.99
FIRST_STOCK, RESTOCK = (20, 200), (50, 200)
LINES, PIECES = (1, 5), (1, 3)
CATEGORY_SHARE, SALE_SHARE = 0.05, 0.3
DRIFT, SALE = (0.03, 0.15), (0.20, 0.40)
FIRST_PRICE = (5, 500)

ADDRESSES = 10_000  # numbered houses


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that belongs to a key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def whole(seed: int, low: int, high: int, *key: Column) -> Column:
    """A whole number from ``low`` to ``high``."""
    return (F.floor(uniform(seed, *key) * (high - low + 1)) + low).cast("bigint")


def choice(u: Column, shares: dict[str, float]) -> Column:
    """The name whose part of the summed shares ``u`` falls into."""
    out, total = None, sum(shares.values())
    at = 0.0
    for name, share in list(shares.items())[:-1]:
        at += share / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    last = list(shares)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def picked(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows at random; the same ones for the same seed."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}"))), key).limit(n)


def emptiest(stock: DataFrame, seed: int, among: int = 10) -> DataFrame:
    """One shelf at random among those with least on them."""
    low = stock.orderBy("quantity", "product_id", "warehouse_id").limit(among)
    return picked(low, F.col("product_id") * 1000 + F.col("warehouse_id"), 1, seed)


def load(spark: SparkSession, n: int, rate: float, seed: int, start: str = "2026-01-01 00:00:00", block: int = 10_000) -> DataFrame:
    """``id, at, action``: of ``n`` chances at ``rate`` a second at the busiest hour those that the hour lets through.

    Gaps are exponential.  They are added up block by block and the blocks'
    sums among themselves, so no task sorts the whole load.
    """
    gaps = spark.range(n).withColumn("gap", -F.log(F.lit(1.0) - uniform(seed, F.col("id"), F.lit("gap"))) / rate).withColumn("block", F.floor(F.col("id") / block))
    sums = gaps.groupBy("block").agg(F.sum("gap").alias("sum"))
    before = sums.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("before"))  # a row a block
    within = F.sum("gap").over(Window.partitionBy("block").orderBy("id"))
    timed = gaps.withColumn("within", within).join(before, "block")
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + F.round((F.col("before") + F.col("within")) * 1_000_000).cast("bigint")
    rows = timed.select("id", F.timestamp_micros(micros).alias("at"))
    hour = ((F.hour("at") + SHOP_HOURS_AHEAD) % 24 + 1).cast("int")
    passes = uniform(seed, F.col("id"), F.lit("hour")) * max(HOURLY) < F.element_at(F.array(*map(F.lit, HOURLY)), hour)
    return rows.where(passes).withColumn("action", choice(uniform(seed, F.col("id"), F.lit("action")), ACTIONS))


def _of(actions: DataFrame, kind: str) -> DataFrame:
    return actions.where(F.col("action") == kind).select("id", "at")


def new_orders(actions: DataFrame, customers: int, stock: DataFrame, prices: DataFrame, seed: int, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, their one to five lines of different products in stock at the present price, and what is left on the shelves.

    ``customers`` is how many there are (numbered from 1).  An order looks at
    ``most`` shelves at random and takes the first that hold something.
    Shelves are numbered once; what several orders want of one is dealt out in
    the order of time, so none falls below zero.
    """
    shelves = stock.join(prices, "product_id").withColumn("shelf", F.row_number().over(Window.orderBy("product_id", "warehouse_id")))  # a shop's shelves, not its orders
    many = F.broadcast(shelves.agg(F.max("shelf").alias("many")))
    orders = _of(actions, "new_order").select(F.col("id").alias("order_id"), whole(seed, 1, customers, F.col("id"), F.lit("who")).alias("customer_id"), F.lit("created").alias("status"), F.col("at").alias("created_at"))
    tries = orders.crossJoin(many).select("order_id", "created_at", "many", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n"))
    tries = tries.withColumn("shelf", (F.floor(uniform(seed, F.col("order_id"), F.col("n")) * F.col("many")) + 1).cast("int")).join(shelves, "shelf").where("quantity > 0")
    first = tries.withColumn("again", F.row_number().over(Window.partitionBy("order_id", "product_id").orderBy("n"))).where("again = 1")
    lines = first.withColumn("line", F.row_number().over(Window.partitionBy("order_id").orderBy("n"))).where(F.col("line") <= whole(seed, *LINES, F.col("order_id"), F.lit("lines")))
    lines = lines.withColumn("wanted", whole(seed, *PIECES, F.col("order_id"), F.col("line"), F.lit("quantity")))
    queue = Window.partitionBy("product_id", "warehouse_id").orderBy("created_at", "order_id")
    free = F.col("quantity") - (F.sum("wanted").over(queue) - F.col("wanted"))
    lines = lines.withColumn("taken", F.least("wanted", F.greatest(free, F.lit(0)))).where("taken > 0")
    sold = lines.groupBy("product_id", "warehouse_id").agg(F.sum("taken").alias("sold"))
    left = stock.join(sold, ["product_id", "warehouse_id"], "left").withColumn("quantity", F.col("quantity") - F.coalesce("sold", F.lit(0))).drop("sold")
    items = lines.select((F.col("order_id") * 10 + F.col("line")).alias("order_item_id"), "order_id", "product_id", "warehouse_id", F.col("taken").alias("quantity"), F.col("price").alias("price_at_order"))
    return orders.join(items.select("order_id").distinct(), "order_id", "left_semi"), items, left


def advanced_orders(actions: DataFrame, orders: DataFrame, seed: int) -> DataFrame:
    """Open orders that take a step: as many as there are such actions, each at most one, to a state that may follow its own."""
    wanted = F.broadcast(_of(actions, "advance_order").agg(F.count("*").alias("wanted"), F.max("at").alias("at")))
    open_ = orders.where(F.col("status").isin(*STEPS))
    share = F.broadcast(open_.agg(F.count("*").alias("open")))
    moving = open_.crossJoin(wanted).crossJoin(share).where(uniform(seed, F.col("order_id"), F.lit("moves")) * F.col("open") < F.col("wanted"))
    u, step = uniform(seed, F.col("order_id"), F.col("status")), None
    for state, following in STEPS.items():
        step = F.when(F.col("status") == state, choice(u, following)) if step is None else step.when(F.col("status") == state, choice(u, following))
    return moving.select("order_id", F.col("status").alias("before"), step.alias("status"), F.col("at").alias("updated_at"))


def new_customers(actions: DataFrame, known: int, seed: int) -> DataFrame:
    """Customers numbered on from ``known`` by the action's id."""
    i = F.col("id")
    return _of(actions, "new_customer").select(
        (F.lit(known + 1) + i).alias("customer_id"), F.concat(F.lit("customer "), i.cast("string")).alias("name"), whole(seed, 1, ADDRESSES, i, F.lit("address")).cast("string").alias("address"),
        F.element_at(F.array(*map(F.lit, SEGMENTS)), whole(seed, 1, len(SEGMENTS), i, F.lit("segment")).cast("int")).alias("segment"), F.col("at").alias("updated_at"),
    )


def _another(names: tuple[str, ...], present: Column, u: Column) -> Column:
    """Any name but the present one (any at all if that is none of them)."""
    rest = F.filter(F.array(*map(F.lit, names)), lambda x: ~x.eqNullSafe(present))
    return F.element_at(rest, (F.floor(u * F.size(rest)) + 1).cast("int"))


def updated_customers(actions: DataFrame, customers: DataFrame, seed: int) -> DataFrame:
    """Customers whose address or segment changes, always to another."""
    chosen = _chosen(actions, "update_customer", customers, "customer_id", seed)
    u = uniform(seed, F.col("customer_id"), F.col("at"), F.lit("which"))
    moves = u < 0.5
    there = F.coalesce(F.col("address").try_cast("bigint"), F.lit(0))
    house = (F.pmod(there + whole(seed, 1, ADDRESSES - 1, F.col("customer_id"), F.col("at")) - 1, F.lit(ADDRESSES)) + 1).cast("string")
    return chosen.select("customer_id", "name", F.when(moves, house).otherwise(F.col("address")).alias("address"), F.when(moves, F.col("segment")).otherwise(_another(SEGMENTS, F.col("segment"), u * 2 - 1)).alias("segment"), F.col("at").alias("updated_at"))


def _chosen(actions: DataFrame, kind: str, rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows that an action of a kind falls on: as many as there are such actions, by the share of the table that they are."""
    wanted = F.broadcast(_of(actions, kind).agg(F.count("*").alias("_wanted"), F.max("at").alias("at")))
    many = F.broadcast(rows.agg(F.count("*").alias("_many")))
    hit = uniform(seed, F.col(key), F.lit(kind)) * F.col("_many") < F.col("_wanted")
    return rows.crossJoin(wanted).crossJoin(many).where(hit).drop("_wanted", "_many")


def updated_products(actions: DataFrame, products: DataFrame, seed: int, category_share: float = CATEGORY_SHARE, sale_share: float = SALE_SHARE) -> DataFrame:
    """Products whose price drifts (by ``DRIFT``) or goes on sale (``SALE`` off), or, rarely, whose category changes; always to another."""
    chosen = _chosen(actions, "update_product", products, "product_id", seed)
    key = (F.col("product_id"), F.col("at"))
    u, v, w = (uniform(seed, *key, F.lit(x)) for x in ("what", "how", "much"))
    factor = F.when(v < sale_share, 1 - SALE[0] - (SALE[1] - SALE[0]) * w).otherwise(1 + F.when(v < (1 + sale_share) / 2, -1).otherwise(1) * (DRIFT[0] + (DRIFT[1] - DRIFT[0]) * w))
    price = F.greatest(F.least(F.round(F.col("price").cast("double") * factor, 2), F.lit(float(MOST_PRICE))), F.lit(float(LEAST_PRICE))).cast("decimal(10,2)")
    cent = F.lit("0.01").cast("decimal(10,2)")
    price = F.when(price != F.col("price"), price).when(F.col("price") <= LEAST_PRICE, F.col("price") + cent).otherwise(F.col("price") - cent).cast("decimal(10,2)")
    moves = u < category_share
    return chosen.select("product_id", "name", F.when(moves, _another(CATEGORIES, F.col("category"), v)).otherwise(F.col("category")).alias("category"), F.when(moves, F.col("price")).otherwise(price).alias("price"), F.col("at").alias("updated_at"))


def new_products(actions: DataFrame, known: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Products numbered on from ``known``, and their first stock in every warehouse."""
    i = F.col("id")
    rows = _of(actions, "new_product").select(
        (F.lit(known + 1) + i).alias("product_id"), F.concat(F.lit("product "), i.cast("string")).alias("name"), F.element_at(F.array(*map(F.lit, CATEGORIES)), whole(seed, 1, len(CATEGORIES), i, F.lit("category")).cast("int")).alias("category"),
        (whole(seed, *FIRST_PRICE, i, F.lit("price")) - F.lit("0.01").cast("decimal(10,2)")).cast("decimal(10,2)").alias("price"), F.col("at").alias("updated_at"),
    )
    shelves = rows.select("product_id", F.explode(F.array(*map(F.lit, WAREHOUSES))).alias("warehouse_id"), "updated_at")
    return rows, shelves.select("product_id", "warehouse_id", whole(seed, *FIRST_STOCK, F.col("product_id"), F.col("warehouse_id")).cast("int").alias("quantity"), "updated_at")


def restocked(actions: DataFrame, stock: DataFrame, seed: int, among: tuple[int, int] = RESTOCK) -> DataFrame:
    """One of the ten emptiest shelves, filled for each such action of the batch."""
    added = F.broadcast(_of(actions, "restock").agg(F.coalesce(F.sum(whole(seed, *among, F.col("id"), F.lit("restock"))), F.lit(0)).alias("added"), F.max("at").alias("updated_at")))
    return emptiest(stock, seed).crossJoin(added).where("added > 0").select("product_id", "warehouse_id", (F.col("quantity") + F.col("added")).cast("int").alias("quantity"), "updated_at")
