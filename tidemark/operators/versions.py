"""Views over append-only journals: newest versions, conflicts, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of greatest ``order`` per key; ``order`` should be total.

    Written as a rank filter: Spark cuts each task's groups to one row before
    the shuffle (window group limit), so a hot key costs one row a task.
    """
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def latest_live(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], deleted: str = "is_deleted") -> DataFrame:
    """``latest`` without the keys whose newest row is a delete."""
    return latest(df, keys, order).where(F.col(deleted) == 0)


def conflicts(df: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys under which different contents are stored (least and greatest hash differ; no set of rows is kept)."""
    h = F.xxhash64(*content)
    return df.groupBy(*keys).agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count("*").alias("n_rows")).where("lo <> hi").drop("lo", "hi")


def replay_summary(changes: DataFrame, key: str, op: str, position: str, version: str) -> DataFrame:
    """One row over a change log: live keys, counts by operation, repeated deliveries.

    A key is live if its last operation isn't a delete; rows of one key,
    version and operation after the first are repeats.
    """
    last = changes.groupBy(key).agg(F.max_by(op, position).alias("last")).agg(F.count_if(F.col("last") != "d").alias("live_keys"))
    counts = changes.agg(*[F.count_if(F.col(op) == o).alias(f"n_{o}") for o in "cudr"])
    times = changes.groupBy(key, version, op).agg((F.count("*") - 1).alias("again")).agg(F.coalesce(F.sum("again"), F.lit(0)).cast("long").alias("duplicates"))
    return last.crossJoin(counts).crossJoin(times)
