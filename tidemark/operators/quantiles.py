"""Exact quantiles of groups of any size.

Equal values count as one with their number.  A first pass adds these up in
bins of a fixed scale (64 to every doubling), from which follows the bin that
holds each wanted rank; a second pass sorts the values of those bins alone.
All of it is grouped sums and windows over bins: nothing holds the values of a
group together, neither a buffer nor a task, and partial sums merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64  # to every doubling of a value's size


def bin_of(value: Column) -> Column:
    """The bin of a whole number; bins are in the order of their numbers and about a hundredth of them wide."""
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1) * BINS)
    return (F.signum(value.cast("double")) * size).cast("int")


def exact_quantiles(df: DataFrame, groups: Sequence[str], values: dict[str, Column], shares: Sequence[float]) -> DataFrame:
    """``groups`` and a column ``<name>_<share>`` (a double) for every value and share, between the two nearest ranks in proportion.

    ``values`` are whole numbers; nulls don't count, and where a group has none
    of a value its quantiles are null.  Groups without any value have no row.
    """
    names = list(groups)
    each = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("long").alias("value")) for n, v in values.items()])
    rows = df.select(*names, F.explode(each).alias("_v")).select(*names, "_v.name", "_v.value").where(F.col("value").isNotNull())
    counted = rows.groupBy(*names, "name", "value").agg(F.count("*").alias("n")).withColumn("bin", bin_of(F.col("value")))

    by = [*names, "name"]
    bins = counted.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    behind = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    bins = bins.withColumns({"before": F.coalesce(F.sum("n").over(behind), F.lit(0)), "total": F.sum("n").over(whole)})
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in shares]
    wanted = F.array(*[F.struct(F.lit(i).alias("share"), up.alias("upper"), (F.ceil(at) if up_ else F.floor(at)).alias("rank"), (at - F.floor(at)).alias("rest")) for i, at in enumerate(place) for up_, up in ((False, F.lit(0)), (True, F.lit(1)))])
    here = F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n")))
    chosen = bins.withColumn("wanted", here).where(F.size("wanted") > 0).select(*by, "bin", "before", "wanted")

    inside = Window.partitionBy(*by, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    few = counted.join(chosen, [*by, "bin"]).withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    hits = F.filter("wanted", lambda w: (w["rank"] >= F.col("from")) & (w["rank"] < F.col("from") + F.col("n")))
    few = few.select(*by, "value", F.explode(hits).alias("w")).select(*by, "value", "w.*")

    out = []
    for name in values:
        for i, p in enumerate(shares):
            mine = (F.col("name") == name) & (F.col("share") == i)
            low, high = (F.max(F.when(mine & (F.col("upper") == u), F.col("value").cast("double"))) for u in (0, 1))
            rest = F.max(F.when(mine, F.col("rest")))
            out.append((low + (high - low) * rest).alias(f"{name}_{p}"))
    return few.groupBy(*names).agg(*out)
