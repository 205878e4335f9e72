import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import alerts
from tidemark.operators import quality, reconcile
from tidemark.plans import formats, marts, panels, queries, results
from tidemark.plans.refresh import states_of
from tidemark.streaming import stream

T = datetime(2026, 1, 1)


def test_log_is_rewritten_by_a_retry(spark, tmp_path):
    log = results.ResultLog(spark, f"file://{tmp_path}/log")
    bad = {"check_name": "c", "table_name": "t", "status": "violation", "violations": 3, "sample_keys": ["7", "ключ"], "error": None}
    log.append(results.rows(spark, "dq", "scheduled__1", [bad, {"check_name": "summary", "table_name": "", "status": "violation", "violations": 3}], T, planned_for=T))
    log.append(results.rows(spark, "dq", "scheduled__1", [bad | {"status": "ok", "violations": 0, "sample_keys": []}], T + timedelta(hours=1)))
    got = {r["check_name"]: r for r in log.read().collect()}
    assert got["c"]["status"] == "ok" and got["c"]["details"] == "{}" and got["summary"]["violations"] == 3 and got["summary"]["logical_date"] == T
    first = results.rows(spark, "dq", "r", [bad], T).first()
    assert json.loads(first["details"]) == {"sample_keys": ["7", "ключ"]}


def test_previous_status_of_planned_runs(spark):
    def run(name, status, hours):
        return results.rows(spark, "rec", name, [{"check_name": "summary", "table_name": "", "status": status}], T + timedelta(hours=hours))

    log = run("scheduled__1", "source_unavailable", 0).unionByName(run("manual__1", "ok", 1)).unionByName(run("scheduled__2", "violation", 2))
    assert results.previous_status(log, "rec", "summary", "scheduled__2") == "source_unavailable"
    assert results.previous_status(log, "rec", "summary", "scheduled__3") == "violation"
    assert results.previous_status(log, "other", "summary", "x") is None
    down = results.previous_status(log, "rec", "summary", "scheduled__2") == "source_unavailable"
    assert reconcile.outcome({}, False, False, not down) == ("source_unavailable", True)


def test_checks_from_run_to_log(spark):
    tables = {"stg_inventory": spark.createDataFrame([(1, 1, -2, 1, 0), (2, 1, 5, 1, 0)], "product_id long, warehouse_id int, quantity int, version long, is_deleted int")}
    checks = tuple(c for c in quality.CHECKS if c.name in ("negative_inventory", "negative_revenue"))
    got = {r["check_name"]: r for r in quality.run(tables, F.lit(T), checks)}
    assert got["negative_inventory"]["violations"] == 1 and got["negative_revenue"]["status"] == "error" and got["summary"]["status"] == "error"
    rows = results.rows(spark, "dq", "manual__1", list(got.values()), T).collect()
    assert {r["check_name"]: json.loads(r["details"]).get("sample_keys") for r in rows}["negative_inventory"] == ["1/1"]


def test_summary_samples_in_order(spark):
    found = spark.range(500).select(F.format_string("%04d", F.col("id")).alias("sample_key"))
    r = quality.summary("c", "t", found).first()
    assert r["violations"] == 500 and r["sample_keys"] == [f"{i:04d}" for i in range(10)]
    r = quality.summary("c", "t", found.where("false")).first()
    assert (r["violations"], r["sample_keys"]) == (0, [])


def test_cutoff_is_whole_seconds_and_batches(spark):
    now = F.lit("2026-01-01 10:00:00.999").cast("timestamp")
    assert spark.range(1).select(reconcile.cutoff_of(now)).first()[0] == datetime(2026, 1, 1, 9, 45)
    rows = lambda x: spark.range(1000).select("id", (F.col("id") + F.when(F.col("id") % 10 == 0, x).otherwise(0)).alias("v"), F.lit(T).alias("at"))
    a, b = (reconcile.Side(rows(x), F.col("id"), (F.col("v"),), F.col("at")) for x in (0, 1))
    parts = list(reconcile.compared(a, b, F.lit(T + timedelta(days=1)), at_once=50))
    assert len(parts) > 1 and sorted(r["k"] for p in parts for r in p.collect()) == list(range(0, 1000, 10))
    assert list(reconcile.compared(a, a, F.lit(T + timedelta(days=1)))) == []


def test_panels_name_queries():
    assert len({p.id for p in panels.PANELS}) == 27 and {p.query for p in panels.PANELS} <= set(queries.QUERIES) and {p.form for p in panels.PANELS} == {"stat", "table", "series"}


def test_row_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a b"), (2, "", "ü\t")], "i int, n string, s string").coalesce(1)

    def text(form, **options):
        formats.write_rows(df, form, f"{tmp_path}/{form}{len(options)}", **options)
        return next((tmp_path / f"{form}{len(options)}").glob("part-*")).read_text().splitlines()

    assert text("tsv")[0] == "1\t\\N\ta b" and text("separated", separator="|", header=True) == ["i|n|s", "1|\\N|a b", "2||ü\t"]
    assert [json.loads(x) for x in text("json")] == [{"i": 1, "n": None, "s": "a b"}, {"i": 2, "n": "", "s": "ü\t"}]
    assert "|a b|" in formats.write_rows(df, "pretty").replace(" |", "|").replace("| ", "|") and formats.write_rows(df, "null") is None
    with pytest.raises(ValueError):
        formats.write_rows(df, "xml")


def test_states_and_progress(spark):
    told = states_of(spark, [{"name": "m", "status": "Error", "last_success_time": None, "last_error": "x"}])
    assert marts.pipeline_health({}, told).first()["last_error"] == "x"
    alive = stream.Liveness()

    class Event:
        def __init__(self, ms):
            self.progress = type("P", (), {"json": json.dumps({"numInputRows": 2, "durationMs": {"triggerExecution": ms}})})

    for ms in range(1, 101):
        alive.onQueryProgress(Event(ms))
    assert alive.stats() == {"batches": 100, "rows": 200, "max": 100, "p50": 51, "p95": 96, "p99": 100}


def test_measured_sizes_reach_the_panel(spark, tmp_path):
    sink = stream.Sink(spark, f"{tmp_path}/sink")
    for t, n in (("a", 10), ("b", 10_000)):
        sink.append(t, spark.range(n), "0")
    log = results.size_rows(spark, "retention", "scheduled__1", sink.sizes(), {"a": 10, "b": 10_000}, T)
    rows = panels.table_sizes(log).collect()
    assert [r["table_name"] for r in rows] == ["b", "a"] and rows[0]["bytes"] > rows[1]["bytes"] > 0 and int(rows[0]["ch_value"]) == 10_000


def test_probe_of_the_channel(spark):
    assert alerts.probe(lambda t: 200)["status"] == "ok"
    bad = alerts.probe(lambda t: 500)
    assert results.rows(spark, "channel", "scheduled__1", [bad], T).first()["status"] == "error"


def test_extra_keys_are_looked_at_again_later(spark):
    waited = []

    def side(ids):
        return reconcile.Side(spark.createDataFrame([(i,) for i in ids], "id long"), F.col("id"), (F.col("id"),), F.lit(T))

    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = reconcile.rechecked(keys, lambda: (side([2]), side([1, 2])), waited.append)
    assert [r["k"] for r in got.collect()] == [1] and waited == [600]
    assert reconcile.rechecked(keys.limit(0), lambda: None, waited.append).isEmpty() and waited == [600]
