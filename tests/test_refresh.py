import threading
import time

from pyspark.sql import functions as F

from tidemark.plans import querylog
from tidemark.plans.refresh import MartStore, Node, refresh, states_of


def slow(spark, n, seconds):
    """A frame whose computation takes some time inside Spark's tasks."""

    def work(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(n).coalesce(1).mapInArrow(work, "id long")


def test_independent_nodes_overlap_and_dependents_wait(spark, tmp_path):
    store = MartStore(spark, f"{tmp_path}/m")
    nodes = [
        Node("revenue", lambda: store.read("left").unionAll(store.read("right")), ("left", "right")),
        Node("left", lambda: slow(spark, 3, 1.5)),
        Node("right", lambda: slow(spark, 4, 1.5)),
    ]
    states = {s["name"]: s for s in refresh(store, nodes)}
    assert {s["status"] for s in states.values()} == {"Scheduled"}
    a, b, c = states["left"], states["right"], states["revenue"]
    assert max(a["started_at"], b["started_at"]) < min(a["ended_at"], b["ended_at"])
    assert c["started_at"] >= max(a["ended_at"], b["ended_at"])
    assert store.read("revenue").count() == 7
    assert states_of(spark, list(states.values())).count() == 3
    alone = {s["name"]: s for s in refresh(store, nodes, at_once=1)}
    assert min(alone["left"]["ended_at"], alone["right"]["ended_at"]) <= max(alone["left"]["started_at"], alone["right"]["started_at"])


def test_a_failed_branch_stops_only_what_needs_it(spark, tmp_path):
    store = MartStore(spark, f"{tmp_path}/m")

    def broken():
        raise RuntimeError("no source\nsecond line")

    nodes = [Node("a", broken), Node("b", lambda: spark.range(2)), Node("over_a", lambda: spark.range(1), ("a",)), Node("over_b", lambda: store.read("b"), ("b",))]
    states = {s["name"]: (s["status"], s["attempts"]) for s in refresh(store, nodes, retries=1)}
    assert states == {"a": ("Error", 2), "b": ("Scheduled", 1), "over_a": ("Skipped", 0), "over_b": ("Scheduled", 1)}
    assert store.read("over_b").count() == 2


def test_a_node_over_its_time_is_cancelled_alone(spark, tmp_path):
    store = MartStore(spark, f"{tmp_path}/m")
    slow(spark, 1, 0).collect()  # so that no worker has to be started within the time
    nodes = [Node("long", lambda: slow(spark, 2, 60)), Node("short", lambda: slow(spark, 2, 1))]
    began = time.monotonic()
    states = {s["name"]: s for s in refresh(store, nodes, retries=0, limit_s=12)}
    assert time.monotonic() - began < 40
    assert states["long"]["status"] == "Error" and "cancel" in states["long"]["last_error"].lower()
    assert states["short"]["status"] == "Scheduled"


def test_log_of_real_executions(spark, tmp_path):
    log = querylog.QueryLog(spark, f"{tmp_path}/log")
    store = MartStore(spark, f"{tmp_path}/m")
    spark.range(1000).write.parquet(f"{tmp_path}/in")
    nodes = [Node("a", lambda: spark.read.parquet(f"{tmp_path}/in").groupBy((F.col("id") % 7).alias("k")).count()), Node("b", lambda: store.read("a"), ("a",))]
    for _ in range(3):
        refresh(store, nodes)
    for _ in range(2):
        with querylog.labelled(spark, "panel", "seven"):
            assert len(store.read("a").collect()) == 7
    with querylog.labelled(spark, "panel", "broken"):
        try:
            spark.range(5).select(F.raise_error(F.lit("boom")).cast("string")).collect()
        except Exception:  # noqa: BLE001  the log is to tell of it
            pass
    spark.range(3).collect()
    assert log.take() > 0
    rows = log.read()
    refreshes = {r["name"]: r for r in querylog.refresh_statistics(rows).collect()}
    assert {n: (r["runs"], r["errors"]) for n, r in refreshes.items()} == {"a": (3, 0), "b": (3, 0)}
    a = refreshes["a"]
    assert 0 < a["p50_ms"] <= a["p95_ms"] <= a["max_ms"] and a["max_rows_read"] == 1000 and a["max_memory_bytes"] > 0
    panels = {r["name"]: (r["runs"], r["errors"]) for r in querylog.panel_statistics(rows).collect()}
    assert panels == {"seven": (2, 0), "broken": (1, 1), None: (3, 1)}
    told = rows.where("kind = 'panel' and name = 'broken'").first()
    assert told["status"] == "error" and told["error"]
    wrote = rows.where("kind = 'refresh' and rows_written > 0 and name = 'a'").first()
    assert (wrote["rows_written"], wrote["failed_tasks"]) == (7, 0) and wrote["tasks"] > 0 and wrote["shuffle_bytes"] > 0 and wrote["bytes_read"] > 0
    assert rows.groupBy("execution_id").count().where("count > 1").isEmpty()
    assert log.missed == 0


def test_log_is_taken_in_parts_and_waits_for_what_runs(spark, tmp_path):
    log = querylog.QueryLog(spark, f"{tmp_path}/log")
    running = threading.Thread(target=lambda: slow(spark, 1, 4).collect())
    running.start()
    time.sleep(1.5)
    with querylog.labelled(spark, "report", "first"):
        spark.range(10).collect()
    log.take()
    assert log.read().where("name = 'first'").count() == 1
    running.join()
    with querylog.labelled(spark, "report", "second"):
        spark.range(10).collect()
    log.take()
    log.take()
    rows = log.read()
    assert {r["name"] for r in rows.where("kind = 'report'").collect()} == {"first", "second"}
    assert rows.where("kind = 'other' and wall_ms > 2000").count() == 1
    assert rows.groupBy("execution_id").count().where("count > 1").isEmpty()
    # the writes of the log are no entries of it
    assert rows.where("description like 'querylog%'").isEmpty()
