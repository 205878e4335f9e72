"""Dimensions with validity intervals (SCD type 2) from a journal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "timestamp_seconds(0)"
ROWS_A_TASK = 500_000


def spread(journal: DataFrame, key: str, a_task: int = ROWS_A_TASK) -> DataFrame:
    """The journal shuffled by key, over so many tasks that one sorts some ``a_task`` rows, whatever their number in all.

    A small journal is left to adaptive execution, which makes no more tasks of it than there are cores.
    """
    tasks = journal.count() // a_task  # told by the files' footers
    return journal.repartition(tasks, key) if tasks > journal.sparkSession.sparkContext.defaultParallelism else journal.repartition(key)


def build(journal: DataFrame, key: str, attributes: Sequence[str], tie: Sequence[str | Column] = ()) -> DataFrame:
    """``key, attributes, valid_from, valid_to, is_current, version``.

    Order is that of versions, not of clocks.  Rows that change no attribute
    open nothing; a delete ends a version and is none; a first row from a
    snapshot is valid since the epoch; the last one is open (null).  Journal
    rows of one key and time count as one, the greatest version.

    One shuffle by key serves all passes: one in the order of times, which
    leaves the greatest version of each, and two in that of versions, which
    share a sort (what they look back at are plain columns, and the order's own
    columns stay as they are until the end).
    """
    newest = [F.desc(c) if isinstance(c, str) else c.desc() for c in ("version", *tie)]
    times = Window.partitionBy(key).orderBy("valid_from", *newest)
    rows = spread(journal, key).withColumns({"_n": F.row_number().over(times), "_time": F.lag("valid_from").over(times)})
    rows = rows.where((F.col("_n") == 1) | ~F.col("valid_from").eqNullSafe(F.col("_time"))).drop("_n", "_time")
    by = Window.partitionBy(key).orderBy("version", "valid_from")
    state = {c: f"_before_{c}" for c in (*attributes, "is_deleted")}
    rows = rows.withColumns({before: F.lag(c).over(by) for c, before in state.items()} | {"_n": F.row_number().over(by)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(before)) for c, before in state.items()])
    rows = rows.where((F.col("_n") == 1) | ~same)
    since = F.when((F.col("_n") == 1) & (F.col("is_snapshot") == 1), F.expr(EPOCH)).otherwise(F.col("valid_from"))
    rows = rows.withColumn("_since", since).withColumn("valid_to", F.lead("_since").over(by))
    live = rows.where(F.col("is_deleted") == 0)
    return live.select(key, *attributes, F.col("_since").alias("valid_from"), "valid_to", F.col("valid_to").isNull().cast("tinyint").alias("is_current"), "version")


def gaps(dimension: DataFrame, key: str) -> DataFrame:
    """Versions whose end is not the start of the next one (legal after a delete)."""
    by = Window.partitionBy(key).orderBy("version", "valid_from")
    rows = dimension.withColumn("next_from", F.lead("valid_from").over(by))
    return rows.where(F.col("next_from").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("next_from")))
