"""A table of what batch queries took: time, rows, bytes, memory, outcome.

Spark keeps the state of every SQL execution, job and stage it ran; ``QueryLog``
reads those that have ended since it last looked and appends a row for each to
Parquet.  ``labelled`` names the work of a block, so that statistics can be told
by kind (``refresh``, ``panel``) and name.  Spark keeps the last
``spark.sql.ui.retainedExecutions`` executions (1,000), so ``take`` at least as
often as so many end; what was lost is told by ``missed``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "application_id string, execution_id long, kind string, name string, description string, status string, error string, started_at timestamp, ended_at timestamp, wall_ms long, cpu_ms long, "
    "tasks long, failed_tasks long, rows_read long, bytes_read long, rows_written long, bytes_written long, shuffle_bytes long, spilled_bytes long, peak_memory long"
)
KINDS = ("refresh", "panel", "check", "report")
OWN = "querylog"  # writes of the log itself, which isn't told of them


@contextmanager
def labelled(spark: SparkSession, kind: str, name: str) -> Iterator[None]:
    """What this thread runs inside the block is logged as ``kind`` and ``name``."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.job.description")
    sc.setJobDescription(f"{kind}:{name}")
    try:
        yield
    finally:
        sc.setLocalProperty("spark.job.description", before)


class QueryLog:
    """Ended executions of this session's application as rows of the folder ``path``.

    ``take`` reads what has ended since the last call; several threads may call
    it.  Rows of stages that several executions share count in the one that ran
    them; ``peak_memory`` is what the tasks of the largest stage held together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._sql = spark._jsparkSession.sharedState().statusStore()
        self._core = spark._jsc.sc().statusStore()
        self._app = spark.sparkContext.applicationId
        self._lock = threading.Lock()
        self._done: set[int] = set()
        self._next = self._newest() + 1
        self.missed = 0

    def _newest(self) -> int:
        known = self._sql.executionsList()
        return known.apply(known.size() - 1).executionId() if known.size() else -1

    def _settled(self) -> None:
        """Events reach the state by a queue: waits until what has ended is there."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)

    def _stages(self, execution) -> dict[str, int]:  # noqa: ANN001  a Java object
        out = dict.fromkeys(("cpu_ms", "tasks", "failed_tasks", "rows_read", "bytes_read", "rows_written", "bytes_written", "shuffle_bytes", "spilled_bytes", "peak_memory"), 0)
        for i in filter(None, execution.stages().mkString(",").split(",")):
            try:
                s = self._core.lastStageAttempt(int(i))
            except Py4JJavaError:
                continue  # a stage that another execution had already run
            out["cpu_ms"] += s.executorCpuTime() // 1_000_000
            out["tasks"] += s.numCompleteTasks()
            out["failed_tasks"] += s.numFailedTasks()
            out["rows_read"] += s.inputRecords()
            out["bytes_read"] += s.inputBytes()
            out["rows_written"] += s.outputRecords()
            out["bytes_written"] += s.outputBytes()
            out["shuffle_bytes"] += s.shuffleWriteBytes()
            out["spilled_bytes"] += s.diskBytesSpilled()
            out["peak_memory"] = max(out["peak_memory"], s.peakExecutionMemory())
        return out

    def _row(self, e) -> tuple | None:  # noqa: ANN001  a Java object
        if e.completionTime().isEmpty():
            return None
        began, ended = e.submissionTime(), e.completionTime().get().getTime()
        error = e.errorMessage().get() if e.errorMessage().isDefined() else ""
        text = e.description() or ""
        kind, _, name = text.partition(":") if text.partition(":")[0] in KINDS else ("other", "", text)
        at = [datetime.fromtimestamp(ms / 1000, UTC) for ms in (began, ended)]
        values = {"application_id": self._app, "execution_id": e.executionId(), "kind": kind, "name": name, "description": text, "status": "error" if error else "ok", "error": error.split("\n")[0][:500]}
        values |= {"started_at": at[0], "ended_at": at[1], "wall_ms": ended - began} | self._stages(e)
        return tuple(values[c.split()[0]] for c in COLUMNS.split(", "))

    def take(self) -> int:
        """Appends the executions that have ended since the last call; how many.  What still runs comes with a later call."""
        with self._lock:
            self._settled()
            known = self._sql.executionsList()
            n = known.size()
            if n and known.apply(0).executionId() > self._next:
                self.missed += known.apply(0).executionId() - self._next
                self._next = known.apply(0).executionId()
            rows, running = [], []
            for i in range(n):
                e = known.apply(i)
                if e.executionId() < self._next or e.executionId() in self._done or (e.description() or "").startswith(f"{OWN}:"):
                    continue
                if (row := self._row(e)) is None:
                    running.append(e.executionId())
                else:
                    self._done.add(e.executionId())
                    rows.append(row)
            newest = known.apply(n - 1).executionId() if n else self._next - 1
            self._next = min([newest + 1, *running])
            self._done = {i for i in self._done if i >= self._next}
            if rows:
                with labelled(self.spark, OWN, "write"):
                    self.spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{self.path}/part={uuid.uuid4().hex}")
            return len(rows)

    def read(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(f"{self.path}/part=*").drop("part")


def statistics(log: DataFrame, *by: str) -> DataFrame:
    """Of each group: executions, errors, percentiles of the milliseconds of those that went well, most memory, most rows read."""
    well = F.when(F.col("status") == "ok", F.col("wall_ms"))
    return log.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.percentile(well, F.lit(0.5)).alias("p50_ms"),
        F.percentile(well, F.lit(0.95)).alias("p95_ms"),
        F.max(well).alias("max_ms"),
        F.max("peak_memory").alias("max_memory_bytes"),
        F.max("rows_read").alias("max_rows_read"),
        F.sum("cpu_ms").alias("cpu_ms"),
    )


def refresh_statistics(log: DataFrame, since: datetime | None = None) -> DataFrame:
    """How the refreshes of each mart went; a refresh is the executions under its label that wrote rows."""
    rows = log.where((F.col("kind") == "refresh") & (F.col("rows_written") > 0))
    return statistics(rows if since is None else rows.where(F.col("started_at") >= F.lit(since)), "name")


def panel_statistics(log: DataFrame, since: datetime | None = None) -> DataFrame:
    """How the queries of panels went, all together as well (``name`` null)."""
    rows = log.where(F.col("kind") == "panel")
    rows = rows if since is None else rows.where(F.col("started_at") >= F.lit(since))
    return statistics(rows, "name").unionByName(statistics(rows).withColumn("name", F.lit(None).cast("string")))
