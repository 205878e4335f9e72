"""The log of check results: one row per job, run, check and table, written again by a retry."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versions import latest

# Names of the log's columns.
COLUMNS = "dag_id string, run_id string, logical_date timestamp, check_name string, table_name string, status string, pg_value decimal(38,0), ch_value decimal(38,0), violations long, cutoff timestamp, details string, checked_at timestamp"
KEY = ["dag_id", "run_id", "check_name", "table_name"]
PLANNED = "scheduled__"


def rows(spark: SparkSession, job: str, run: str, results: Sequence[dict], checked_at: datetime, planned_for: datetime | None = None, cutoff: datetime | None = None) -> DataFrame:
    """Results as rows of the log; what has no column of its own goes into ``details`` as JSON."""
    own = {c.split()[0] for c in COLUMNS.split(", ")}
    made = []
    for r in results:
        rest = {k: v for k, v in r.items() if k not in own and v not in (None, [])}
        values = {"dag_id": job, "run_id": run, "logical_date": planned_for, "cutoff": cutoff, "checked_at": checked_at, "details": json.dumps(rest, ensure_ascii=False, default=str), "violations": 0} | {k: v for k, v in r.items() if k in own}
        values |= {k: Decimal(values[k]) for k in ("pg_value", "ch_value") if values.get(k) is not None}
        made.append(tuple(values.get(c.split()[0]) for c in COLUMNS.split(", ")))
    return spark.createDataFrame(made, COLUMNS)


def newest(log: DataFrame) -> DataFrame:
    """The rows that count: of several for one key the one checked last."""
    return latest(log, KEY, ["checked_at"])


def previous_status(log: DataFrame, job: str, check: str, run: str) -> str | None:
    """The summary status of the latest other planned run; runs by hand neither start nor break a series."""
    before = newest(log).where((F.col("dag_id") == job) & (F.col("check_name") == check) & (F.col("table_name") == "") & (F.col("run_id") != run) & F.col("run_id").startswith(PLANNED))
    return before.agg(F.max_by("status", "checked_at").alias("s")).first()["s"]


class ResultLog:
    """The log as a folder of Parquet files; every append is a file set of its own, so a crash leaves whole runs only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/part={uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        return newest(self.spark.read.schema(COLUMNS).parquet(f"{self.path}/part=*"))


def size_rows(spark: SparkSession, job: str, run: str, sizes: DataFrame, counts: dict[str, int], checked_at: datetime) -> DataFrame:
    """Measured ``sizes(table_name, n_files, bytes)`` as results: rows of each table where ``counts`` has them, bytes and files in the details."""
    told = [{"check_name": "table_size", "table_name": r["table_name"], "status": "ok", "ch_value": counts.get(r["table_name"]), "bytes_on_disk": r["bytes"], "files": r["n_files"]} for r in sizes.collect()]
    return rows(spark, job, run, told, checked_at)
