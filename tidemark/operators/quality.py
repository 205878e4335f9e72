"""Data-quality checks: each yields its violating keys; the runner keeps them apart.

A check is a function from the named tables to rows with a text column
``sample_key``, or a file of SQL (``catalogue``).  ``together`` finds what all
of them find in one plan that reads each table once; where that plan breaks,
``run`` takes them one by one: a check that breaks is an ``error`` of its own
and stops no other; errors outrank violations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import conflicts, latest, latest_live

SAMPLE = 10
LAG = "INTERVAL 15 MINUTES"
ROLLOUT = "1970-01-01"  # orders from before lines were recorded aren't asked for them
Tables = Mapping[str, DataFrame]

ORDERS_KEY, ITEMS_KEY, STOCK_KEY = ["order_id"], ["order_item_id"], ["product_id", "warehouse_id"]
ORDER_CONTENT = ["customer_id", "status", "created_at", "updated_at", "is_deleted"]
ITEM_CONTENT = ["order_id", "product_id", "quantity", "price_at_order", "is_deleted"]
# Of several rows of a key the greatest by these columns is its last one.
ORDER_LAST = ["version", "customer_id", "status", "created_at", "event_time", "is_deleted"]
ITEM_LAST = ["version", "product_id", "quantity", "price_at_order", "event_time", "is_deleted"]
PRODUCT_LAST = ["version", "valid_from", "category", "price", "is_deleted"]
STOCK_LAST = ["version", "quantity", "is_deleted"]


@dataclass(frozen=True)
class Check:
    name: str
    table: str
    hint: str
    find: Callable[[Tables, Column], DataFrame]


def _keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("sample_key"))


def _old(time: str, as_of: Column) -> Column:
    return F.col(time) < as_of - F.expr(LAG)


def _live_orders(t: Tables) -> DataFrame:
    return latest_live(t["stg_orders"], ORDERS_KEY, ORDER_LAST)


def _live_items(t: Tables) -> DataFrame:
    return latest_live(t["stg_order_items"], ITEMS_KEY, ITEM_LAST)


def _duplicate_facts(t: Tables, as_of: Column) -> DataFrame:
    return _keys(t["fact_orders"].groupBy("order_item_id").count().where("count > 1"), "order_item_id")


def _order_conflicts(t: Tables, as_of: Column) -> DataFrame:
    return _keys(conflicts(t["stg_orders"], [*ORDERS_KEY, "version"], ORDER_CONTENT), "order_id", "version")


def _item_conflicts(t: Tables, as_of: Column) -> DataFrame:
    return _keys(conflicts(t["stg_order_items"], [*ITEMS_KEY, "version"], ITEM_CONTENT), "order_item_id", "version")


def _several_current(t: Tables, as_of: Column) -> DataFrame:
    parts = []
    for name, key in (("dim_customers", "customer_id"), ("dim_products", "product_id")):
        many = t[name].where("is_current = 1").groupBy(key).count().where("count > 1")
        parts.append(many.select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("sample_key")))
    return parts[0].unionByName(parts[1])


def _odd_items(t: Tables, as_of: Column) -> DataFrame:
    return _keys(_live_items(t).where("quantity <= 0 or price_at_order < 0"), "order_item_id")


def _odd_prices(t: Tables, as_of: Column) -> DataFrame:
    return _keys(latest(t["stg_product_versions"], ["product_id"], PRODUCT_LAST).where("is_deleted = 0 and price < 0"), "product_id")


def _odd_stock(t: Tables, as_of: Column) -> DataFrame:
    return _keys(latest_live(t["stg_inventory"], STOCK_KEY, STOCK_LAST).where("quantity < 0"), *STOCK_KEY)


def _odd_revenue(t: Tables, as_of: Column) -> DataFrame:
    return _keys(t["mart_revenue_daily"].where("revenue < 0 or revenue_net < 0"), "order_date", "category")


def _orphan_items(t: Tables, as_of: Column) -> DataFrame:
    # Every order ever seen counts, deleted ones as well.
    old = _live_items(t).where(_old("event_time", as_of))
    return _keys(old.join(t["stg_orders"].select("order_id"), "order_id", "left_anti"), "order_item_id")


def _bare_orders(t: Tables, as_of: Column, since: str = ROLLOUT) -> DataFrame:
    old = _live_orders(t).where(_old("event_time", as_of) & (F.col("created_at") >= F.lit(since).cast("timestamp")))
    return _keys(old.join(t["stg_order_items"].select("order_id"), "order_id", "left_anti"), "order_id")


def _state_differs(t: Tables, as_of: Column) -> DataFrame:
    last = t["stg_order_status_history"].groupBy("order_id").agg(F.max_by("status", "version").alias("last_status"), F.max("changed_at").alias("last_at"))
    both = _live_orders(t).join(last, "order_id")
    return _keys(both.where((F.col("status") != F.col("last_status")) & _old("event_time", as_of) & _old("last_at", as_of)), "order_id")


def _history_alone(t: Tables, as_of: Column) -> DataFrame:
    last = t["stg_order_status_history"].groupBy("order_id").agg(F.max("changed_at").alias("changed_at"))
    return _keys(last.where(_old("changed_at", as_of)).join(t["stg_orders"].select("order_id"), "order_id", "left_anti"), "order_id")


CHECKS = (
    Check("fact_duplicate_items", "fact_orders", "a line stands in the fact more than once", _duplicate_facts),
    Check("orders_conflicting_versions", "stg_orders", "one version, different contents", _order_conflicts),
    Check("order_items_conflicting_versions", "stg_order_items", "one version, different contents", _item_conflicts),
    Check("dim_multiple_current", "dim_products", "a key has several current versions", _several_current),
    Check("negative_order_items", "stg_order_items", "no or negative quantity, or negative price", _odd_items),
    Check("negative_prices", "stg_product_versions", "the current price is negative", _odd_prices),
    Check("negative_inventory", "stg_inventory", "negative stock", _odd_stock),
    Check("negative_revenue", "mart_revenue_daily", "a mart sum is negative", _odd_revenue),
    Check("orphan_order_items", "stg_order_items", "no order was ever seen for the line", _orphan_items),
    Check("orders_without_items", "stg_orders", "no line was ever seen for the order", _bare_orders),
    Check("status_differs_from_history", "stg_orders", "the state is not the last one of its history", _state_differs),
    Check("history_without_order", "stg_order_status_history", "no order was ever seen for the history", _history_alone),
)


NAME, KEY = "check_name", "sample_key"


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias(NAME), KEY)


def _ranked(df: DataFrame, keys: list[str], last: list[str]) -> DataFrame:
    """Adds ``main`` (the last row of its key) and ``torn`` (the row before holds other contents, ``h``, under the same version)."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in last])
    torn = (F.lag("version").over(by) == F.col("version")) & (F.lag("h").over(by) != F.col("h"))
    return df.withColumns({"main": F.row_number().over(by) == 1, "torn": F.coalesce(torn, F.lit(False))})


def shared(t: Tables, as_of: Column, since: str = ROLLOUT) -> DataFrame:
    """``check_name, sample_key`` of all of ``CHECKS`` (a key may stand there several times); each table is read once.

    Lines are ranked by their key, then lines, orders and the history of orders
    meet by order, and every row tells what it violates.
    """
    # Hashes hardly compress: those of lines are made behind their shuffle and go no further.
    lines = t["stg_order_items"].repartition("order_item_id").withColumn("h", F.xxhash64(*ITEM_CONTENT))
    lines = _ranked(lines, ITEMS_KEY, [*ITEM_LAST, "order_id"]).drop("h")
    orders = t["stg_orders"].withColumn("h", F.xxhash64(*ORDER_CONTENT))
    kinds = {"version": "bigint", "h": "bigint", "customer_id": "bigint", "status": "string", "created_at": "timestamp", "event_time": "timestamp", "is_deleted": "int", "item": "bigint", "odd": "boolean", "main": "boolean", "torn": "boolean"}

    def rows(df: DataFrame, kind: int, **cols: Column) -> DataFrame:
        return df.select("order_id", F.lit(kind).alias("kind"), *[cols.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    odd = (F.col("quantity") <= 0) | (F.col("price_at_order") < 0)
    # Of a line go on only the values that a check may still ask for.
    asked = F.col("main") & (F.col("is_deleted") == 0)
    told_of = {"item": F.when(asked | F.col("torn"), F.col("order_item_id")), "event_time": F.when(asked, F.col("event_time")), "version": F.when(F.col("torn"), F.col("version"))}
    met = rows(orders, 0).unionByName(rows(lines, 1, odd=odd, **told_of)).unionByName(rows(t["stg_order_status_history"], 2, event_time=F.col("changed_at")))
    # Rows of the three kinds of one order, each in their own order: of orders and the history the last row is found.
    met = met.repartition("order_id").withColumnsRenamed({"main": "main_line", "torn": "torn_line"})
    met = _ranked(met, ["order_id", "kind"], ORDER_LAST)
    order = Window.partitionBy("order_id")
    past = (F.col("kind") == 2) & F.col("main")
    met = met.withColumns({
        "known": F.max(F.col("kind") == 0).over(order), "lines": F.max(F.col("kind") == 1).over(order),
        "past_status": F.max(F.when(past, F.col("status"))).over(order), "past_at": F.max(F.when(F.col("kind") == 2, F.col("event_time"))).over(order),
    })

    def key(*cols: str) -> Column:
        return F.concat_ws("/", *[F.col(c).cast("string") for c in cols])

    old, past_old, live, no_key = _old("event_time", as_of), _old("past_at", as_of), F.col("is_deleted") == 0, F.col("order_id").isNull()
    is_order, is_line = (F.col("kind") == 0) & F.col("main"), (F.col("kind") == 1) & F.col("main_line")
    told = {
        "orders_conflicting_versions": ((F.col("kind") == 0) & F.col("torn"), key("order_id", "version")),
        "order_items_conflicting_versions": ((F.col("kind") == 1) & F.col("torn_line"), key("item", "version")),
        "negative_order_items": (is_line & live & F.col("odd"), key("item")),
        "orphan_order_items": (is_line & live & old & (~F.col("known") | no_key), key("item")),
        "orders_without_items": (is_order & live & old & (F.col("created_at") >= F.lit(since).cast("timestamp")) & (~F.col("lines") | no_key), key("order_id")),
        "status_differs_from_history": (is_order & live & old & past_old & (F.col("status") != F.col("past_status")) & ~no_key, key("order_id")),
        "history_without_order": (past & past_old & (~F.col("known") | no_key), key("order_id")),
    }
    hits = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(n).alias(NAME), k.alias(KEY))) for n, (hit, k) in told.items()]))
    found = met.select(F.explode(hits).alias("v")).select("v.*")
    return reduce(DataFrame.unionAll, [_named(c.name, c.find(t, as_of)) for c in CHECKS if c.name not in told], found)


def together(tables: Tables, as_of: Column, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """``check_name, table_name, violations, sample_keys`` of all checks in one plan.

    What is found is shuffled once, dealt by its key: counts are partial sums,
    and of the keys a task passes on its first ``SAMPLE``.
    """
    own = [c for c in checks if c not in CHECKS]
    parts = [shared(tables, as_of).where(F.col(NAME).isin([c.name for c in checks]))] if len(own) < len(checks) else []
    found = reduce(DataFrame.unionAll, parts + [_named(c.name, c.find(tables, as_of)) for c in own])
    return _listed(found, checks)


def _listed(found: DataFrame, checks: Iterable[Check]) -> DataFrame:
    spark = found.sparkSession
    dealt = found.groupBy(NAME, KEY).agg(F.count("*").alias("_times"))
    counts = dealt.groupBy(NAME).agg(F.count("*").alias("violations"), F.max("_times").alias("_times"))
    first = Window.partitionBy(NAME).orderBy(KEY)
    keys = dealt.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE).groupBy(NAME).agg(F.array_sort(F.collect_list(KEY)).alias("sample_keys"))
    names = spark.createDataFrame([(i, c.name, c.table) for i, c in enumerate(checks)], f"_i int, {NAME} string, table_name string")
    out = names.join(counts, NAME, "left").join(keys, NAME, "left")
    return out.select(NAME, "table_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"), F.coalesce("sample_keys", F.array().cast("array<string>")).alias("sample_keys"))


def summary(name: str, table: str, found: DataFrame) -> DataFrame:
    """``check_name, table_name, violations, sample_keys`` of one check: the exact count and the first ``SAMPLE`` keys in order."""
    return _listed(_named(name, found), [Check(name, table, "", lambda t, a: found)])


def told(rows: DataFrame) -> DataFrame:
    """Rows of checks with ``status``, and one row for the whole: violation before ok, violations added up."""
    rolled = rows.rollup(F.struct(NAME, "table_name", "sample_keys").alias("check")).agg(F.sum("violations").alias("violations"))
    out = rolled.select(
        F.coalesce(F.col(f"check.{NAME}"), F.lit("summary")).alias(NAME), F.coalesce("check.table_name", F.lit("")).alias("table_name"),
        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"), F.coalesce("check.sample_keys", F.array().cast("array<string>")).alias("sample_keys"),
    )
    return out.withColumn("status", F.when(F.col("violations") > 0, "violation").otherwise("ok"))


def _result(row: dict) -> dict:
    return {"check_name": row[NAME], "table_name": row["table_name"], "status": "violation" if row["violations"] else "ok", "violations": row["violations"], "sample_keys": list(row["sample_keys"]), "error": None}


def run(tables: Tables, as_of: Column, checks: tuple[Check, ...] = CHECKS) -> list[dict]:
    """One result a check, and one for the whole: error > violation > ok, violations added up.

    All checks go together first; only if that breaks, each goes alone.
    """
    try:
        by_name = {r[NAME]: _result(r) for r in together(tables, as_of, checks).collect()}
        results = [by_name[c.name] for c in checks]
    except Exception:  # noqa: BLE001  which check it was is told by the runs below
        results = []
        for c in checks:
            try:
                results.append(_result(summary(c.name, c.table, c.find(tables, as_of)).first()))
            except Exception as e:  # noqa: BLE001  a broken check must not hide the others
                results.append({"check_name": c.name, "table_name": c.table, "status": "error", "violations": 0, "sample_keys": [], "error": str(e).split("\n")[0][:300]})
    rank = {"ok": 0, "violation": 1, "error": 2}
    worst = max((r["status"] for r in results), key=rank.__getitem__, default="ok")
    results.append({"check_name": "summary", "table_name": "", "status": worst, "violations": sum(r["violations"] for r in results), "sample_keys": [], "error": None})
    return results


def catalogue(folder: str | Path) -> tuple[Check, ...]:
    """The checks of a folder's files ``NN_name.sql``, by number.

    A file begins with a line ``-- table: name`` and lines ``-- hint: text``;
    its query names tables in braces (``{stg_orders}``), may use ``:as_of``, and
    gives the violating keys in a column ``sample_key``.  A file that cannot be
    read as such is a check that breaks.
    """
    found = []
    for path in sorted(Path(folder).glob("[0-9]*_*.sql"), key=lambda p: (int(re.match(r"\d+", p.name)[0]), p.name)):
        text = path.read_text()
        heads = re.findall(r"^-- (table|hint):[ \t]*(.*)$", text, re.M)
        table = next((v.strip() for k, v in heads if k == "table"), "")
        hint = " ".join(v.strip() for k, v in heads if k == "hint")
        found.append(Check(re.sub(r"^\d+_", "", path.stem), table, hint, _query_of(path.name, text, table)))
    return tuple(found)


def _query_of(name: str, text: str, table: str) -> Callable[[Tables, Column], DataFrame]:
    body = re.sub(r"^\s*--.*$", "", text, flags=re.M).strip()

    def find(t: Tables, as_of: Column) -> DataFrame:
        if not table or not body:
            raise ValueError(f"{name} has no table or no query")
        used = set(re.findall(r"\{(\w+)\}", body))
        spark = next(iter(t.values())).sparkSession
        moment = spark.range(1).select(as_of.alias("t")).first()["t"]
        return spark.sql(body, args={"as_of": moment}, **{n: t[n] for n in used}).select(F.col(KEY).cast("string").alias(KEY))

    return find
