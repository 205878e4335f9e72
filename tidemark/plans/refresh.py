"""Full-refresh marts: recompute, write aside, swap, in dependency order.

Each refresh writes a new folder and then renames a pointer file over the old
one in one step, so readers see the old rows or the new ones, and a refresh
that fails or dies leaves the old ones.  Old folders stay for a grace time, for
readers that had begun with them.  Nodes that don't wait for each other are
refreshed side by side, each under a job tag and in a scheduler pool of its own.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import Files

from .querylog import labelled


@dataclass(frozen=True)
class Node:
    name: str
    build: Callable[[], DataFrame]
    after: tuple[str, ...] = ()


class MartStore:
    """Marts under one folder of any file system that Spark reaches; one writer a mart at a time."""

    def __init__(self, spark: SparkSession, root: str, grace_s: float = 3600):
        self.spark, self.root, self.grace_s = spark, root.rstrip("/"), grace_s
        self.files = Files(spark, self.root)

    def _current(self, name: str) -> str | None:
        text = self.files.text(f"{name}/current.json")
        return None if text is None else json.loads(text)["folder"]

    def read(self, name: str) -> DataFrame:
        folder = self._current(name)
        if folder is None:
            raise FileNotFoundError(f"{name} was never refreshed")
        return self.spark.read.parquet(f"{self.root}/{name}/{folder}")

    def write(self, name: str, df: DataFrame, at: datetime | None = None) -> None:
        folder = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        self._point(name, folder, at or datetime.now(UTC))
        self.sweep(name)

    def _point(self, name: str, folder: str, at: datetime) -> None:
        self.files.swap(f"{name}/current.json", json.dumps({"folder": folder, "refreshed_at": at.isoformat()}))

    def refreshed_at(self, name: str) -> datetime | None:
        """When the rows that readers now see were written."""
        text = self.files.text(f"{name}/current.json")
        return None if text is None else datetime.fromisoformat(json.loads(text)["refreshed_at"])

    def sweep(self, name: str) -> int:
        """Deletes folders but the current one whose successor is older than the grace time; how many."""
        current = self._current(name)
        folders = [f for f in self.files.folders(name) if f.startswith("v-")]
        gone = 0
        for folder, after in zip(folders, folders[1:]):
            if folder != current and time.time_ns() - int(after.split("-")[1]) > self.grace_s * 1e9:
                gone += self.files.delete(f"{name}/{folder}")
        return gone


def ordered(nodes: list[Node]) -> list[Node]:
    """Dependencies first, otherwise as listed."""
    done: list[Node] = []
    names: set[str] = set()
    rest = list(nodes)
    while rest:
        ready = next((n for n in rest if set(n.after) <= names), None)
        if ready is None:
            raise ValueError(f"circular or unknown dependencies: {[n.name for n in rest]}")
        rest.remove(ready)
        done.append(ready)
        names.add(ready.name)
    return done


def _one(store: MartStore, node: Node, retries: int, pause_s: float, limit_s: float | None, clock: Callable[[], datetime]) -> dict:
    """Refreshes a node, again after failures; its jobs are cancelled by their tag where an attempt takes longer than ``limit_s``."""
    sc = store.spark.sparkContext
    state = {"name": node.name, "status": "Error", "last_success_time": store.refreshed_at(node.name), "last_error": "", "attempts": 0, "started_at": datetime.now(UTC)}
    sc.setLocalProperty("spark.scheduler.pool", f"refresh-{node.name}")
    for attempt in range(retries + 1):
        state["attempts"] = attempt + 1
        tag = f"refresh-{node.name}-{uuid.uuid4().hex}"
        over = threading.Event()
        late = threading.Timer(limit_s, lambda tag=tag, over=over: (over.set(), sc.cancelJobsWithTag(tag))) if limit_s else None
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        try:
            if late:
                late.start()
            with labelled(store.spark, "refresh", node.name):
                store.write(node.name, node.build(), at := clock())
            state |= {"status": "Scheduled", "last_success_time": at, "last_error": ""}
            break
        except Exception as e:  # noqa: BLE001  told in the state, other marts go on
            state |= {"status": "Error", "last_error": f"cancelled after {limit_s} s" if over.is_set() else str(e).split("\n")[0][:300]}
            if attempt < retries:
                time.sleep(pause_s)
        finally:
            if late:
                late.cancel()
            sc.removeJobTag(tag)
    return state | {"ended_at": datetime.now(UTC)}


def refresh(store: MartStore, nodes: list[Node], retries: int = 3, pause_s: float = 0.0, at_once: int = 4, limit_s: float | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> list[dict]:
    """Refreshes all nodes, up to ``at_once`` at a time, each as soon as those before it are done.

    State rows in the order of ``ordered``: ``name, status, last_success_time,
    last_error``, and the ``attempts``, ``started_at`` and ``ended_at`` of this
    refresh.  What depends on a failed node is skipped and, like that node,
    keeps its old rows and the time of its last success; other branches go on.
    """
    order = ordered(nodes)
    states: dict[str, dict] = {}
    running: dict[Future, Node] = {}
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        waiting = list(order)
        while waiting or running:
            for node in [n for n in waiting if all(a in states for a in n.after)]:
                waiting.remove(node)
                if all(states[a]["status"] == "Scheduled" for a in node.after):
                    work = inheritable_thread_target(store.spark)(_one)
                    running[pool.submit(work, store, node, retries, pause_s, limit_s, clock)] = node
                else:
                    states[node.name] = {"name": node.name, "status": "Skipped", "last_success_time": store.refreshed_at(node.name), "last_error": "", "attempts": 0, "started_at": None, "ended_at": None}
            if running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    states[running.pop(f).name] = f.result()
    return [states[n.name] for n in order]


def refresh_every(store: MartStore, nodes: list[Node], tell: Callable[[list[dict]], None], stop: threading.Event, every_s: float = 120, retries: int = 3) -> int:
    """Refreshes on a fixed beat until ``stop`` is set; a beat that a long refresh has missed is left out.  How many refreshes there were."""
    began, rounds = time.monotonic(), 0
    while not stop.is_set():
        tell(refresh(store, nodes, retries))
        rounds += 1
        stop.wait(every_s - (time.monotonic() - began) % every_s)
    return rounds


def states_of(spark: SparkSession, states: list[dict]) -> DataFrame:
    """What ``refresh`` told, as the table that ``marts.pipeline_health`` reads."""
    return spark.createDataFrame([(s["name"], s["status"], s["last_success_time"], s["last_error"]) for s in states], "name string, status string, last_success_time timestamp, last_error string")
