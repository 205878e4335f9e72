"""Named dashboard queries over marts and check results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import NEVER, hours_crossed, money, percent, status_rank

STEPS = ("created", "paid", "shipped", "delivered", "cancelled")
DURATIONS = ("median_to_paid", "p90_to_paid", "median_to_delivered", "p90_to_delivered")


def between(df: DataFrame, first: str, last: str, day: str = "order_date") -> DataFrame:
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def trailing(df: DataFrame, as_of: Column, days: int, day: str = "order_date") -> DataFrame:
    """The last ``days`` days, the current one included."""
    return df.where((F.col(day) >= F.date_sub(F.to_date(as_of), days - 1)) & (F.col(day) <= F.to_date(as_of)))


def revenue_total(revenue: DataFrame) -> DataFrame:
    return revenue.agg(money(F.sum("revenue_net")).alias("revenue_net"))


def orders_total(funnel: DataFrame) -> DataFrame:
    return funnel.agg(F.sum("created").cast("bigint").alias("created"))


def step_percent(funnel: DataFrame, step: str) -> DataFrame:
    return funnel.agg(percent(F.sum(step), F.sum("created")).alias(f"{step}_pct"))


def revenue_series(revenue: DataFrame) -> DataFrame:
    out = revenue.groupBy("order_date", "category").agg(money(F.sum("revenue_net")).alias("revenue_net"))
    return out.select(F.col("order_date").cast("timestamp").alias("time"), "category", "revenue_net").orderBy("time", "category")


def revenue_by_category(revenue: DataFrame) -> DataFrame:
    out = revenue.groupBy("category").agg(money(F.sum("revenue_net")).alias("revenue_net"), money(F.sum("revenue")).alias("revenue"), F.sum("items").cast("bigint").alias("items"))
    return out.orderBy(F.desc("revenue_net"), "category")


def funnel_series(funnel: DataFrame) -> DataFrame:
    return funnel.select("order_date", *STEPS).orderBy("order_date")


def funnel_durations(funnel: DataFrame) -> DataFrame:
    return funnel.select("order_date", *DURATIONS).orderBy("order_date")


def funnel_totals(funnel: DataFrame) -> DataFrame:
    return funnel.agg(*[F.sum(s).cast("bigint").alias(s) for s in STEPS])


def cohort_pivot(cohorts: DataFrame, months: int = 12) -> DataFrame:
    """Share of each cohort that came back after 0 to ``months`` months, blank where not over yet."""
    cells = []
    for m in range(months + 1):
        here = (F.col("period") == m) & (F.col("is_partial") == 0)
        cells.append(percent(F.sum(F.when(here, F.col("returned"))), F.sum(F.when(here, F.col("customers")))).alias(f"m{m}"))
    return cohorts.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort")).agg(F.max("customers").alias("customers"), *cells).orderBy("cohort")


def cohort_sizes(cohorts: DataFrame) -> DataFrame:
    return cohorts.groupBy("cohort_month").agg(F.max("customers").alias("customers")).orderBy("cohort_month")


def top_products(top: DataFrame, as_of: Column, days: int, n: int = 10) -> DataFrame:
    sold = trailing(top, as_of, days).groupBy("product_id").agg(
        F.max_by("product_name", F.struct("order_date", "category")).alias("product_name"), F.sum("quantity_net").cast("bigint").alias("quantity_net"), money(F.sum("revenue_net")).alias("revenue_net")
    )
    return sold.orderBy(F.desc("revenue_net"), "product_id").limit(n)


def low_count(stock: DataFrame) -> DataFrame:
    return stock.agg(F.count_if(F.col("is_low") == 1).alias("low"))


def stock_total(stock: DataFrame) -> DataFrame:
    return stock.agg(F.sum("quantity").cast("bigint").alias("quantity"))


def stock_by_category(stock: DataFrame) -> DataFrame:
    return stock.groupBy("category").agg(F.sum("quantity").cast("bigint").alias("quantity")).orderBy(F.desc("quantity"), "category")


def lowest_stock(stock: DataFrame, n: int = 50) -> DataFrame:
    low = stock.where("is_low = 1").select("product_id", "warehouse_id", "product_name", "category", "quantity")
    return low.orderBy("quantity", "product_id", "warehouse_id").limit(n)


def seconds_since(df: DataFrame, time: str, as_of: Column, name: str) -> DataFrame:
    return df.agg((F.unix_seconds(as_of) - F.unix_seconds(F.max(time))).alias(name))


def freshness(marts: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Per mart: seconds since its refresh and since the newest event behind it."""
    parts = [
        df.agg((F.unix_seconds(as_of) - F.unix_seconds(F.max("refreshed_at"))).alias("refresh_age"), (F.unix_seconds(as_of) - F.unix_seconds(F.max("source_watermark"))).alias("source_lag")).select(F.lit(name).alias("mart"), "refresh_age", "source_lag")
        for name, df in marts.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("mart")


def source_ages(health: DataFrame, as_of: Column) -> DataFrame:
    rows = health.where("kind = 'source'")
    return rows.select("name", "last_event_time", (F.unix_seconds(as_of) - F.unix_seconds("last_event_time")).alias("age")).orderBy("name")


def view_states(health: DataFrame, as_of: Column) -> DataFrame:
    rows = health.where("kind = 'view'")
    return rows.select("name", "status", "last_success_time", (F.unix_seconds(as_of) - F.unix_seconds("last_success_time")).alias("age"), "last_error").orderBy("name")


def hours_since_runs(results: DataFrame, known: list[str], as_of: Column) -> DataFrame:
    """Hours since each known job's last scheduled run; ``NEVER`` if there is none."""
    last = results.where(F.col("run_id").startswith("scheduled__")).groupBy("dag_id").agg(F.max("checked_at").alias("last"))
    jobs = results.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, known))).alias("dag_id"))
    return jobs.join(last, "dag_id", "left").select("dag_id", F.coalesce(hours_crossed(F.col("last"), as_of), F.lit(NEVER)).alias("hours")).orderBy("dag_id")


def last_runs(results: DataFrame) -> DataFrame:
    """Rows of each job's last scheduled run, the worst first."""
    planned = results.where(F.col("run_id").startswith("scheduled__"))
    last = planned.groupBy("dag_id").agg(F.max_by("run_id", F.struct("checked_at", "run_id")).alias("run_id"))
    rows = results.join(last, ["dag_id", "run_id"], "left_semi")
    return rows.withColumn("rank", status_rank(F.col("status"))).orderBy(F.desc("rank"), "dag_id", "check_name")


def manual_summaries(results: DataFrame, n: int = 10) -> DataFrame:
    rows = results.where(~F.col("run_id").startswith("scheduled__") & (F.col("check_name") == "summary"))
    return rows.orderBy(F.desc("checked_at"), "dag_id", "run_id").limit(n)


def table_sizes(results: DataFrame) -> DataFrame:
    """Sizes told by the last size run, the largest first."""
    sizes = results.where("check_name = 'table_size'")
    last = sizes.agg(F.max("checked_at").alias("checked_at"))
    rows = sizes.join(F.broadcast(last), "checked_at")
    n = F.coalesce(F.get_json_object("details", "$.bytes_on_disk").try_cast("bigint"), F.lit(0))
    return rows.select("table_name", "ch_value", n.alias("bytes")).orderBy(F.desc("bytes"), "table_name")


def latest_size(results: DataFrame, table: str) -> DataFrame:
    rows = results.where((F.col("check_name") == "table_size") & (F.col("table_name") == table))
    return rows.agg(F.max_by("ch_value", "checked_at").alias("ch_value"))


def probe_age(results: DataFrame, check: str, as_of: Column) -> DataFrame:
    """Hours since the last probe that was ok; ``NEVER`` if none was."""
    good = F.max(F.when((F.col("check_name") == check) & (F.col("status") == "ok"), F.col("checked_at")))
    return results.agg(F.coalesce(hours_crossed(good, as_of), F.lit(NEVER)).alias("hours"))


class Panel(NamedTuple):
    """An entry of the dashboard: its number, how its rows are shown, and the query that they come from."""

    id: int
    form: str  # stat, table, or series (a time, a name and a number a row)
    query: str


# Numbers of the panels; several numbers show one query.
PANELS = tuple(
    Panel(int(i), form, query)
    for i, form, query in (
        line.split()
        for line in """
2 stat kpi_stats
3 stat kpi_stats
4 stat paid_pct
5 stat delivered_pct
6 series revenue_series
7 table revenue_by_category
9 series funnel_series
10 series funnel_durations
11 table funnel_totals
13 table retention_pivot
14 series cohort_sizes
16 table top_products_7d
17 table top_products_30d
18 stat stock_stats
19 stat stock_stats
20 table stock_by_category
21 table low_stock
23 stat refresh_age
24 stat latest_size
25 table freshness
26 table source_ages
27 table view_states
28 table map_lookup_sentinel
29 table last_run_status
30 table manual_summaries
31 table table_sizes
32 stat probe_age
""".strip().splitlines()
    )
)
