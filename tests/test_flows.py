import json
import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import alerts
from tidemark.functions.scalars import readable_size
from tidemark.operators import reconcile
from tidemark.operators.versions import latest_live
from tidemark.plans.refresh import MartStore, Node, ordered, refresh, refresh_every
from tidemark.sources.schema import KAFKA
from tidemark.sources.tables import jdbc_options, recorded_stream, replay_text
from tidemark.streaming import stream


def messages(spark, n=40):
    rows = []
    for i in range(n):
        o = {"order_id": i % 10, "customer_id": 1, "status": "paid" if i % 2 else "created", "created_at": f"2026-01-0{1 + i // 20}T00:00:00Z", "updated_at": "2026-01-01T00:00:00Z"}
        if i == 7:
            o["status"] = None
        ms = int(datetime(2026, 1, 1 + i // 20).timestamp() * 1000) + i
        rows.append((bytearray(json.dumps({"order_id": i % 10}).encode()), bytearray(json.dumps({"before": None, "after": o, "op": "u", "source": {"lsn": i, "ts_ms": ms, "ts_us": ms * 1000}}).encode()), "cdc.public.orders", 0, i))
    return spark.createDataFrame(rows, KAFKA)


def state(sink):
    live = latest_live(sink.read("stg_orders"), ["order_id"], ["version", "kafka_offset"]).drop("kafka_offset")
    history = sink.read("stg_order_status_history").dropDuplicates(["order_id", "status", "version"])
    return sorted(map(tuple, live.collect()), key=str), sorted(map(tuple, history.drop("kafka_offset").collect()), key=str)


def test_stream_equals_batch_and_backfill(spark, tmp_path):
    m = messages(spark)
    m.repartition(5).write.parquet(f"{tmp_path}/in")
    one, many, again = (stream.Sink(spark, f"{tmp_path}/{x}") for x in ("one", "many", "again"))
    stream.take(one, m, "0", F.expr("timestamp_seconds(0)"))
    q = stream.start(recorded_stream(spark, f"{tmp_path}/in"), many, f"{tmp_path}/cp", every=None)
    assert q.awaitTermination(120)
    assert state(one) == state(many) and len(state(one)[0]) == 10
    assert many.read("raw_events").count() == 40 and many.read("quarantine_stg_orders").count() == 1
    # A replayed batch and a back-fill run twice change nothing.
    stream.take(one, m, "0", F.expr("timestamp_seconds(0)"))
    assert one.read("raw_events").count() == 40
    for _ in range(2):
        assert stream.backfill(many, "2026-01-01", "2026-02-01", again) == 2
    assert state(again) == state(one)


def test_contract_break_writes_nothing(spark, tmp_path):
    broken = messages(spark, 3).withColumn("value", F.lit("not json").cast("binary"))
    with pytest.raises(stream.ContractBroken):
        stream.take(stream.Sink(spark, f"{tmp_path}/s"), broken, "0")
    assert not (tmp_path / "s").exists()


def test_liveness():
    now = [0.0]
    alive = stream.Liveness(lambda: now[0])
    now[0] = 500
    assert not alive.silent()
    now[0] = 700
    assert alive.silent()
    stopped = []
    alive.watch(lambda: stopped.append(1), step_s=0.01).join(5)
    assert stopped == [1]


def test_refresh_keeps_old_rows_on_failure(spark, tmp_path):
    store = MartStore(spark, f"file://{tmp_path}/marts")
    fail = {"on": False}

    def second():
        if fail["on"]:
            raise RuntimeError("out of memory")
        return store.read("a").select((F.col("id") * 2).alias("id"))

    nodes = [Node("c", lambda: store.read("b"), ("b",)), Node("b", second, ("a",)), Node("a", lambda: spark.range(3))]
    assert [n.name for n in ordered(nodes)] == ["a", "b", "c"]
    assert [s["status"] for s in refresh(store, nodes)] == ["Scheduled"] * 3
    fail["on"] = True
    states = {s["name"]: s for s in refresh(store, nodes, retries=1)}
    assert (states["a"]["status"], states["b"]["status"], states["c"]["status"]) == ("Scheduled", "Error", "Skipped")
    assert states["b"]["last_error"] == "out of memory"
    assert sorted(r["id"] for r in store.read("c").collect()) == [0, 2, 4]
    with pytest.raises(ValueError):
        ordered([Node("x", second, ("y",))])


def test_a_reader_and_a_crash_between_the_steps(spark, tmp_path, monkeypatch):
    store = MartStore(spark, f"file://{tmp_path}/marts")
    store.write("a", spark.range(3))
    reader = store.read("a")
    store.write("a", spark.range(5))
    assert reader.count() == 3 and store.read("a").count() == 5  # the old folder is still there for its reader

    def dies(name, folder, at):
        raise OSError("the driver died")

    monkeypatch.setattr(store, "_point", dies)
    with pytest.raises(OSError):
        store.write("a", spark.range(7))
    monkeypatch.undo()
    assert store.read("a").count() == 5
    store.grace_s = -1
    store.write("a", spark.range(9))
    assert store.read("a").count() == 9 and sum(p.name.startswith("v-") for p in (tmp_path / "marts/a").iterdir()) == 1


def test_refresh_on_a_beat(spark, tmp_path):
    store, stop, told = MartStore(spark, f"file://{tmp_path}/marts"), threading.Event(), []

    def tell(states):
        told.append(states[0]["status"])
        if len(told) == 2:
            stop.set()

    assert refresh_every(store, [Node("a", lambda: spark.range(2))], tell, stop, every_s=0.1) == 2 and told == ["Scheduled"] * 2


def test_a_new_checkpoint_replaces_nothing(spark, tmp_path):
    m = messages(spark)
    m.where("offset < 20").coalesce(1).write.parquet(f"{tmp_path}/one")
    m.where("offset >= 20").coalesce(1).write.parquet(f"{tmp_path}/two")
    sink = stream.Sink(spark, f"{tmp_path}/sink")
    for x in ("one", "two"):
        assert stream.start(recorded_stream(spark, f"{tmp_path}/{x}"), sink, f"{tmp_path}/cp-{x}", every=None).awaitTermination(120)
    assert sink.read("raw_events").count() == 40 and len(sink.folders("raw_events")) == 2
    assert "stg_order_items" not in sink.tables()  # nothing came, nothing was written
    before = state(sink)
    assert sink.compact("raw_events", over=1) == 2 and len(sink.folders("raw_events")) == 1
    assert sink.compact("stg_orders", over=1) == 2 and state(sink) == before and sink.read("raw_events").count() == 40
    assert sink.expire(date(2026, 1, 2)) == 1 and sink.read("raw_events").count() == 20
    sizes = {r["table_name"]: r["bytes"] for r in sink.sizes().collect()}
    assert sizes["raw_events"] > 0 and set(sizes) == set(sink.tables())


def test_history_rows_are_set_aside(spark, tmp_path):
    """Of the transitions, those without a state or an order go aside with a reason."""
    sink = stream.Sink(spark, f"{tmp_path}/s")
    keyless = messages(spark).withColumn("key", F.when(F.col("offset") == 3, F.lit(None)).otherwise(F.col("key")))
    stream.take(sink, keyless, "0")
    aside = {(r["table_name"], r["reason"], r["kafka_offset"]) for t in ("stg_orders", stream.HISTORY) for r in sink.read(f"quarantine_{t}").collect()}
    assert aside == {("stg_orders", "bad status", 7), (stream.HISTORY, "bad status", 7), ("stg_orders", "bad order_id", 3), (stream.HISTORY, "bad order_id", 3)}


def test_marker_file(tmp_path):
    now = [5.0]
    alive = stream.Liveness(lambda: now[0], str(tmp_path / "alive"))
    first = (tmp_path / "alive").read_text()
    alive.rows = 7
    alive.onQueryIdle(None)
    assert first.split()[1] == "0" and (tmp_path / "alive").read_text().split()[1] == "7"


def test_tables_are_utc_in_any_session(spark, tmp_path):
    from tidemark.sources.tables import table

    spark.sql("SELECT TIMESTAMP_NTZ'2026-01-01 00:00:00' AS t").write.parquet(f"{tmp_path}/x.parquet")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert table(spark, str(tmp_path), "x").select(F.unix_seconds("t")).first()[0] == 1_767_225_600
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert table(spark, str(tmp_path), "x").select(F.unix_seconds("t")).first()[0] == 1_767_225_600


def test_jdbc_options():
    o = jdbc_options("jdbc:x", "SELECT a::text FROM t WHERE cut < :cut AND name = :name", {"cut": datetime(2026, 1, 1), "name": "o'Brien"}, "a", (0, 100), 4)
    assert o["dbtable"] == "(SELECT a::text FROM t WHERE cut < TIMESTAMP '2026-01-01 00:00:00' AND name = 'o''Brien') AS q"
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("a", "0", "100", "4")
    with pytest.raises(KeyError):
        jdbc_options("jdbc:x", "SELECT :missing")


ROWS = "id long, name string, price decimal(10,2), at timestamp"


def side(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return reconcile.Side(df, F.col("id"), (F.col("name"), reconcile.price(F.col("price")), reconcile.millis(F.col("at"))), F.col("at"))


def test_reconciliation(spark):
    from decimal import Decimal

    t = datetime(2026, 1, 1, 0, 0, 0, 1500)
    same = [(1, None, Decimal("1.00"), t), (2, "", Decimal("1.00"), t), (3, "o'Brien", Decimal("0.10"), t), (4, "Казань", None, t)]
    a, b = side(spark, same), side(spark, [*same[:2], (3, "o'Brien", Decimal("0.10"), datetime(2026, 1, 1, 0, 0, 0, 1999)), same[3]])
    assert reconcile.differing(reconcile.buckets(a, None), reconcile.buckets(b, None)).count() == 0
    cut, hot = F.lit("2026-06-01").cast("timestamp"), datetime(2026, 7, 1)
    a = side(spark, [*same, (5, "x", Decimal("1.00"), t), (6, "x", Decimal("1.00"), t), (7, "x", Decimal("1.00"), hot), (9, "x", Decimal("1.00"), t)])
    b = side(spark, [*same, (6, "x", Decimal("1.01"), t), (8, "x", Decimal("1.00"), t), (7, "y", Decimal("1.00"), t), (9, "x", Decimal("1.00"), datetime(2026, 1, 1, 0, 0, 0, 2500))])
    within = reconcile.differing(reconcile.buckets(a, None), reconcile.buckets(b, None))
    got = {r["k"]: r["verdict"] for r in reconcile.arbitrate(a, b, cut, within).collect()}
    assert got == {5: "missing", 6: "different", 7: "in_flight", 8: "extra", 9: "different"}
    extra = spark.createDataFrame([(8,)], "k long")
    assert reconcile.still_extra(extra, a, b).count() == 1 and reconcile.still_extra(extra, b, b).count() == 0


def test_capped_sample(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "KEPT_KEYS", 5)
    keys = spark.range(60).select(F.col("id").alias("k"), F.lit("missing").alias("verdict"))
    r = reconcile.verdicts(keys).first()
    assert (r["total"], r["sample"]) == (60, [0, 1, 2, 3, 4])


def test_outcome_policy():
    assert reconcile.outcome({}, False, False, True) == ("source_unavailable", False)
    assert reconcile.outcome({}, False, False, False) == ("source_unavailable", True)
    assert reconcile.outcome({"in_flight": 3}, False, True, True) == ("ok", False)
    assert reconcile.outcome({"extra": 1}, False, True, True) == ("violation", True)
    assert reconcile.outcome({}, True, True, True) == ("lagging", True)


def test_lag(spark):
    target = spark.createDataFrame([(datetime(2026, 1, 1, 0, 0),)], "t timestamp")
    cut = F.lit("2026-01-01 01:00:00").cast("timestamp")
    assert reconcile.lagging(target, spark.createDataFrame([(datetime(2026, 1, 1, 0, 30),)], "t timestamp"), "t", cut)
    assert not reconcile.lagging(target, spark.createDataFrame([(datetime(2026, 1, 1, 0, 4),), (datetime(2026, 1, 1, 0, 57),)], "t timestamp"), "t", cut)


def test_replay_text(spark, tmp_path):
    (tmp_path / "log").write_text('{"id":1}|{"a":"x|y"}\n{"id":2}|null\n')
    rows = replay_text(spark, str(tmp_path / "log")).orderBy("pos").collect()
    assert [(r["key"], r["value"]) for r in rows] == [('{"id":1}', '{"a":"x|y"}'), ('{"id":2}', None)]


def test_alert_text():
    rows = [{"status": "violation", "check_name": f"c{i:02d}", "table_name": "t", "violations": i, "sample_keys": list(range(9))} for i in range(12)]
    rows += [{"status": "error", "check_name": "z", "table_name": "t"}, {"status": "ok", "check_name": "y"}]
    text = alerts.alert_text("job", "run", rows)
    assert text.split("\n")[1].startswith("- error: z") and text.count("\n") == 9 and "and 5 more" in text and "0, 1, 2" in text and ", 3" not in text.split("\n")[2].split(":")[-1]
    assert len(alerts.alert_text("j" * 9000, "r", rows)) == 3800
    answers = [503, 200]
    assert alerts.with_retry(lambda t: answers.pop(0), "x") and not alerts.with_retry(lambda t: 400, "x")
    assert readable_size(1536) == "1.50 KiB"
