"""Source against target: fingerprints by bucket, then keys one by one.

Rows become one canonical text; counts and sums of their 64-bit fingerprints
are compared per bucket of keys, and only differing buckets are looked into.
``differences`` goes down a tree of buckets instead: below a bucket that
differs it looks at its 256 parts, and so on, so that the keys it compares grow
with the differences and not with the table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical, cents, fingerprint
from tidemark.operators.versions import latest, latest_live

BUCKETS = 256
KEPT_KEYS = 1000
GRACE_MINUTES, RECHECK_MINUTES = 15, 10
LEVELS, LEAF_KEYS, NODES = 4, 64, 1024  # of the tree: depth, keys a node that need no further parts, differing nodes that have parts

# Tables, keys and canonical columns of both sides, and the column that tells a
# row's last change (those of journals, - , can't be compared with the source's clock).
COMPARED = """
customers   stg_customer_versions  customer_id               customer_id name address segment                              -
products    stg_product_versions   product_id                product_id name category price                                -
orders      stg_orders             order_id                  order_id customer_id status created_at updated_at             updated_at
order_items stg_order_items        order_item_id             order_item_id order_id product_id quantity price_at_order     created_at
inventory   stg_inventory          product_id warehouse_id   product_id warehouse_id quantity updated_at                   updated_at
"""


@dataclass(frozen=True)
class Side:
    """A table to compare: ``key``, the canonical columns and when a row was last changed."""

    df: DataFrame
    key: Column
    content: tuple[Column, ...]
    changed_at: Column

    def rows(self) -> DataFrame:
        return self.df.select(self.key.cast("bigint").alias("k"), fingerprint(canonical(*self.content)).alias("h"), self.changed_at.alias("at"))


def stock_key(product_id: Column, warehouse_id: Column) -> Column:
    return product_id * 1000 + warehouse_id


def millis(t: Column) -> Column:
    return F.unix_millis(t)


def price(x: Column) -> Column:
    return cents(x)


def cutoff_of(now: Column) -> Column:
    """Rows from before this are old enough to compare: whole seconds, so that clocks of any precision agree."""
    return F.date_trunc("second", now) - F.expr(f"INTERVAL {GRACE_MINUTES} MINUTES")


def _canonical(df: DataFrame, names: list[str]) -> tuple[Column, ...]:
    """Times in milliseconds, money in cents, the rest as it is."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return tuple(millis(F.col(n)) if kinds[n] == "timestamp" else price(F.col(n)) if kinds[n] == "decimal" else F.col(n) for n in names)


def sides(table: str, source: dict[str, DataFrame], staging: dict[str, DataFrame]) -> tuple[Side, Side]:
    """Both sides of a table of ``COMPARED``: operational rows, and the live newest ones of staging.

    Lines change with their order: their time is its creation, and the epoch
    for a line without one, which is compared and not hidden.
    """
    line = next(x for x in COMPARED.strip().splitlines() if x.split()[0] == table)
    name, target, key, columns, changed = re.split(r"\s{2,}", re.sub(r"^(\S+)\s+(\S+)\s+", r"\1  \2  ", line.strip()))
    keys = key.split()
    s, t = source[name], latest_live(staging[target], keys, ["version"])
    if changed == "-":
        t = t.withColumn("_changed", F.lit(None).cast("timestamp"))
        s = s.withColumn("_changed", F.col("updated_at"))
    elif name == "order_items":
        made = [o.select("order_id", F.col("created_at").alias("_changed")) for o in (source["orders"], latest(staging["stg_orders"], ["order_id"], ["version"]))]
        s, t = s.join(made[0], "order_id"), t.join(made[1], "order_id", "left").withColumn("_changed", F.coalesce("_changed", F.timestamp_seconds(F.lit(0))))
    else:
        s, t = (x.withColumn("_changed", F.col(changed)) for x in (s, t))
    k = F.col(keys[0]) if len(keys) == 1 else stock_key(F.col(keys[0]), F.col(keys[1]))
    return Side(s, k, _canonical(s, columns.split()), F.col("_changed")), Side(t, k, _canonical(t, columns.split()), F.col("_changed"))


def compared(source: Side, target: Side, cutoff: Column, at_once: int | None = None) -> Iterator[DataFrame]:
    """Verdicts of the keys of differing buckets, ``at_once`` buckets at a time (all together by default); nothing if all are equal.

    At most ``BUCKETS`` bucket numbers go through the driver.  Buckets are
    compared by rows from before the cutoff, their keys with all rows.  Each
    frame reads both sides anew when it is run, so several of them are for
    callers that take one after the other.
    """
    found = sorted(r["bucket"] for r in differing(buckets(source, cutoff), buckets(target, cutoff)).collect())
    bucket = F.pmod("k", F.lit(BUCKETS))
    for i in range(0, len(found), at_once or BUCKETS):
        yield _judged(*(x.rows().where(bucket.isin(found[i : i + (at_once or BUCKETS)])) for x in (source, target)), cutoff)


def node_of(k: Column, level: int) -> Column:
    """The node of a key, of 256 to the power of ``level``; its last eight bits tell it from the other parts of its parent."""
    return F.shiftrightunsigned(F.xxhash64(k), 64 - 8 * level)


def _digests(rows: DataFrame, level: int, within: list[int] | None) -> DataFrame:
    if within is not None:
        rows = rows.where(node_of(F.col("k"), level - 1).isin(within))
    return rows.groupBy(node_of(F.col("k"), level).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"))


def differing_nodes(source: Side, target: Side, cutoff: Column | None = None, levels: int = LEVELS, enough: int = LEAF_KEYS) -> tuple[int, list[int]]:
    """The level and the nodes of it that hold all differences.

    From level to level only the parts of differing nodes are compared, until
    the nodes hold ``enough`` keys each or fewer, or are more than ``NODES``:
    so at most 256 times that many node numbers come to the driver.
    """
    sides_ = [x.rows() for x in (source, target)]
    if cutoff is not None:
        sides_ = [x.where(F.coalesce(F.col("at") < cutoff, F.lit(True))) for x in sides_]
    within: list[int] | None = None
    for level in range(1, levels + 1):
        found = differing(*(_digests(x, level, within) for x in sides_)).select("bucket", F.greatest(F.coalesce("source_n", F.lit(0)), F.coalesce("target_n", F.lit(0))).alias("n")).collect()
        within = sorted(r["bucket"] for r in found)
        if not found or len(found) > NODES or sum(r["n"] for r in found) <= enough * len(found):
            break
    return level, within or []


def rows_of_nodes(side: Side, level: int, nodes: list[int]) -> DataFrame:
    """The rows under some nodes; a node list of any length stays small beside them."""
    rows = side.rows()
    if len(nodes) <= NODES:
        return rows.where(node_of(F.col("k"), level).isin(nodes))
    chosen = rows.sparkSession.createDataFrame([(n,) for n in nodes], "_node long")
    return rows.join(F.broadcast(chosen), node_of(F.col("k"), level) == F.col("_node"), "left_semi")


def differences(source: Side, target: Side, cutoff: Column, compare_all: bool = False, levels: int = LEVELS, enough: int = LEAF_KEYS) -> DataFrame:
    """``k, verdict`` as ``arbitrate`` gives them, of the keys under the nodes of ``differing_nodes``.

    Nodes are compared by rows from before the cutoff, or by all with
    ``compare_all``; their keys always with all rows.
    """
    level, nodes = differing_nodes(source, target, None if compare_all else cutoff, levels, enough)
    return _judged(*(rows_of_nodes(x, level, nodes) for x in (source, target)), cutoff)


def buckets(side: Side, cutoff: Column | None) -> DataFrame:
    """``bucket, n, checksum`` of rows from before the cutoff (rows without a time count)."""
    rows = side.rows()
    if cutoff is not None:
        rows = rows.where(F.coalesce(F.col("at") < cutoff, F.lit(True)))
    return rows.groupBy(F.pmod("k", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"))


def differing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Buckets whose count or checksum differs, missing ones included."""
    s = source.select("bucket", F.col("n").alias("source_n"), F.col("checksum").alias("source_sum"))
    t = target.select("bucket", F.col("n").alias("target_n"), F.col("checksum").alias("target_sum"))
    both = s.join(t, "bucket", "full_outer")
    return both.where(~(F.col("source_n").eqNullSafe(F.col("target_n")) & F.col("source_sum").eqNullSafe(F.col("target_sum"))))


def arbitrate(source: Side, target: Side, cutoff: Column, within: DataFrame | None = None) -> DataFrame:
    """``k, verdict`` of every key that differs: in_flight, missing, different or extra.

    A key that either side changed at or after the cutoff is in flight,
    whatever else holds.  ``within`` (column ``bucket``) limits the comparison.
    """
    s, t = source.rows(), target.rows()
    if within is not None:
        chosen = within.select("bucket").distinct()
        s, t = (x.withColumn("bucket", F.pmod("k", F.lit(BUCKETS))).join(chosen, "bucket", "left_semi").drop("bucket") for x in (s, t))
    return _judged(s, t, cutoff)


def _judged(s: DataFrame, t: DataFrame, cutoff: Column) -> DataFrame:
    both = s.select("k", F.col("h").alias("sh"), F.col("at").alias("sat")).join(t.select("k", F.col("h").alias("th"), F.col("at").alias("tat")), "k", "full_outer")
    hot = F.coalesce(F.col("sat") >= cutoff, F.lit(False)) | F.coalesce(F.col("tat") >= cutoff, F.lit(False))
    verdict = F.when(F.col("sh").eqNullSafe(F.col("th")), None).when(hot, "in_flight").when(F.col("th").isNull(), "missing").when(F.col("sh").isNotNull(), "different").otherwise("extra")
    return both.select("k", verdict.alias("verdict")).where("verdict is not null")


def verdicts(keys: DataFrame) -> DataFrame:
    """``verdict, total, sample``: exact totals and at most ``KEPT_KEYS`` keys each."""
    some = keys.groupBy("verdict").agg(F.count("*").alias("total"))
    ranked = keys.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(64)))
    for by in (["verdict", "part"], ["verdict"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).where(F.col("n") <= KEPT_KEYS)
    sample = ranked.groupBy("verdict").agg(F.array_sort(F.collect_list("k")).alias("sample"))
    return some.join(sample, "verdict")


def still_extra(keys: DataFrame, source: Side, target: Side) -> DataFrame:
    """Extra keys, looked at again later: still in the target and still not in the source."""
    again = keys.join(target.rows().select("k"), "k", "left_semi")
    return again.join(source.rows().select("k"), "k", "left_anti")


def rechecked(keys: DataFrame, read: Callable[[], tuple[Side, Side]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``still_extra`` on both sides as they are after the recheck time: a tombstone on its way has arrived by then."""
    if keys.isEmpty():
        return keys
    wait(RECHECK_MINUTES * 60)
    return still_extra(keys, *read())


def lagging(target: DataFrame, source: DataFrame, time: str, cutoff: Column, allowance: str = "INTERVAL 5 MINUTES") -> bool:
    """Whether the source has changes from before the cutoff's allowance that the target has none as new as."""
    newest = target.agg(F.max(time).alias("m")).first()["m"]
    due = source.where(F.col(time) < cutoff - F.expr(allowance))
    if newest is not None:
        due = due.where(F.col(time) > F.lit(newest) + F.expr(allowance))
    return not due.limit(1).isEmpty()


def outcome(totals: dict[str, int], lag: bool, source_up: bool, last_source_up: bool) -> tuple[str, bool]:
    """Status of a run and whether it fails: an unreachable source fails only the second time in a row."""
    if not source_up:
        return "source_unavailable", not last_source_up
    if lag:
        return "lagging", True
    if any(totals.get(v, 0) for v in ("missing", "different", "extra")):
        return "violation", True
    return "ok", False
