"""A snapshot of a table that goes on changing, handed over to the tail of its changes.

The table is read in ranges of its key.  The log's position is noted before
(low) and after (high) each read.  A row that changed in between may have been
read before or after the change, so it is taken from the tail alone; any other
row is as it stood at ``high``.  No lock is held and the tail never stops.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import Files

Bound = int | str | None
LOW, HIGH = "_low", "_high"


def key_ranges(df: DataFrame, key: str, parts: int) -> list[tuple[Bound, Bound]]:
    """Some ``parts`` ranges ``[from, to)`` of about as many rows each; the first and the last are open, so that keys to come have a range too."""
    at = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("at")).first()["at"]
    cuts = sorted(set(at or []))[: parts - 1] if parts > 1 else []
    return list(zip([None, *cuts], [*cuts, None]))


def in_range(df: DataFrame, key: str, bounds: tuple[Bound, Bound]) -> DataFrame:
    low, high = bounds
    df = df if low is None else df.where(F.col(key) >= F.lit(low))
    return df if high is None else df.where(F.col(key) < F.lit(high))


class Snapshot:
    """The chunks read so far, in a folder; a run that stops goes on behind its last whole chunk."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def chunks(self) -> list[dict]:
        return json.loads(self.files.text("chunks.json") or "[]")

    def run(self, ranges: Sequence[tuple[Bound, Bound]], read: Callable[[tuple[Bound, Bound]], DataFrame], position: Callable[[], int]) -> int:
        """Reads the ranges that no chunk has yet, one after the other; how many."""
        done = self.chunks()
        known = [tuple(c["range"]) for c in done]
        if any(r not in ranges for r in known):
            raise ValueError("the folder holds chunks of other ranges")
        for bounds in (r for r in ranges if tuple(r) not in known):
            folder = f"chunk-{uuid.uuid4().hex}"
            low = position()
            read(bounds).write.parquet(f"{self.root}/{folder}")
            done.append({"range": list(bounds), "folder": folder, "low": low, "high": position()})
            self.files.swap("chunks.json", json.dumps(done))
        return len(done) - len(known)

    def start(self) -> int:
        """The position from which on the tail is needed."""
        return min(c["low"] for c in self.chunks())

    def rows(self) -> DataFrame:
        """All rows read, with the positions ``_low`` and ``_high`` around their chunk."""
        parts = [self.spark.read.parquet(f"{self.root}/{c['folder']}").withColumns({LOW: F.lit(c["low"]).cast("long"), HIGH: F.lit(c["high"]).cast("long")}) for c in self.chunks()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def handed_over(snapshot: DataFrame, tail: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """Journal rows: what of ``snapshot`` did not change while it was read, as of its ``_high``, and the whole tail behind its start.

    ``tail`` is a journal with ``version`` (the log's position), ``is_snapshot``
    and ``is_deleted``; a snapshot row needs its other columns (those it lacks
    are null).  Changes up to the first ``_low`` are in the snapshot and left out.
    """
    keys = [k for k in key]
    moved = tail.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(version).alias("_at")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    meanwhile = (F.col("_at") > F.col(LOW)) & (F.col("_at") <= F.col(HIGH))
    still = snapshot.join(moved, [*same, meanwhile], "left_anti")
    fixed = {version: F.col(HIGH), "is_snapshot": F.lit(1), "is_deleted": F.lit(0)}
    kinds = dict(tail.dtypes)
    row = [(fixed.get(c) if c in fixed else F.col(c) if c in snapshot.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in tail.columns]
    first = snapshot.agg(F.min(LOW).alias("_first"))
    behind = tail.crossJoin(F.broadcast(first)).where(F.col(version) > F.coalesce(F.col("_first"), F.lit(-1))).drop("_first")
    return still.select(*row).unionByName(behind)
