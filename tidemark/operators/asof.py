"""As-of joins.

Both sides become one timeline per key, in which each left row takes the last
right row before it: one shuffle and one sort, whatever the times are, and no
pairs are made.  A key that holds a large share of the rows (``hot_ranges``
finds such) is cut into ranges of time at its own quantiles; each range begins
with the last version of the ranges before it, so ranges are worked on apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
#: A key is hot if it has more than this many rows and more than a thousandth of all: so there are under a thousand of them.
MANY_ROWS, SHARE = 1_000_000, 1000


def hot_ranges(counted: DataFrame, rows: DataFrame, key: str, time: str, many: int = MANY_ROWS, ranges: int = RANGES) -> DataFrame | None:
    """``_k, _bounds``: the hot keys of ``rows`` and the times that cut each into ``ranges`` of about as many rows; none if no key is hot.

    ``counted`` is a cheaper frame with the key of at least as many rows (or
    ``rows`` again).  Under a thousand keys come to the driver.
    """
    if counted.count() <= many:  # told by the files' footers
        return None
    per_key = counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = per_key.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    limit = max(many, (total["all"] or 0) // SHARE)
    if (total["most"] or 0) <= limit:
        return None
    hot = per_key.where(F.col("n") > limit).select(F.col(key).alias("_k"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_k")).groupBy("_k").agg(F.percentile_approx(F.unix_micros(time), [i / ranges for i in range(1, ranges)], 10_000).alias("_bounds"))
    told = [(r["_k"], sorted(set(r["_bounds"] or []))) for r in found.collect()]
    return rows.sparkSession.createDataFrame(told, found.schema) if told else None


def asof_left_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """Every left row with the right row of its key that is the latest not after it; nulls where none is.

    The right side is unique per key and time.  ``hot``, of ``hot_ranges``,
    names keys whose rows are to be spread.  Left rows without a key or a time
    have no right row.
    """
    names = {f"_c{i}": c for i, c in enumerate(left.columns) if c != key}  # plain columns: what nobody asks for goes into no shuffle
    rows = left.select(F.col(key).alias("_k"), F.unix_micros(left_time).alias("_t"), *[F.col(c).alias(a) for a, c in names.items()])
    versions = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    versions = versions.select(F.col(key).alias("_k"), F.unix_micros(right_time).alias("_t"), F.struct(*take).alias("_take"))
    if hot is None:
        # Rows without a key meet nothing: dealt by their time, so that many of them are no hot key.
        rows = rows.withColumn("_range", F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("_t"), F.lit(1024))).otherwise(0).cast("int"))
        found = _timeline(rows, versions.withColumn("_range", F.lit(0)))
    else:
        found = _timeline(*_ranged(rows, versions, F.broadcast(hot)))
    back = {c: F.col(a) for a, c in names.items()} | {key: F.col("_k").cast(left.schema[key].dataType)}
    return found.select(*[back[c].alias(c) for c in left.columns], *[F.col(f"_found.`{c}`").alias(c) for c in take])


def _ranged(rows: DataFrame, versions: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their ranges of hot keys, versions also with those carried into ranges."""

    def ranged(df: DataFrame) -> DataFrame:
        at = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_t"))), F.lit(0))
        df = df.join(hot, "_k", "left").withColumn("_range", F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("_t"), F.lit(1024))).otherwise(at).cast("int"))
        return df.withColumn("_hot", F.col("_bounds").isNotNull()).drop("_bounds")

    rows, versions = ranged(rows).drop("_hot"), ranged(versions)
    # The last version of each range of a hot key, carried up to the next range that has one: at most a row a range.
    last = versions.where("_hot").groupBy("_k", "_range").agg(F.max_by(F.struct("_t", "_take"), "_t").alias("_last")).join(hot, "_k")
    until = F.coalesce(F.lead("_range").over(Window.partitionBy("_k").orderBy("_range")), F.size("_bounds"))
    carried = last.withColumn("_until", until).where(F.col("_range") < F.col("_until")).withColumn("_to", F.explode(F.sequence(F.col("_range") + 1, F.col("_until"))))
    carried = carried.select("_k", F.col("_last._t").alias("_t"), F.col("_last._take").alias("_take"), F.col("_to").alias("_range"))
    return rows, versions.drop("_hot").unionByName(carried)


def _timeline(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Left rows with the last version before or at them in their key and range as ``_found``; a version comes before the rows of its very time."""
    both = versions.withColumn("_left", F.lit(False)).unionByName(rows.withColumn("_left", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("_k", "_range").orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found: Column = F.last("_take", ignorenulls=True).over(before)
    return both.withColumn("_found", found).where("_left")
