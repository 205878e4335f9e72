import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scd2
from tidemark.operators.asof import asof_left_join, hot_ranges
from tidemark.operators.versions import conflicts, latest, latest_live, replay_summary

JOURNAL = "customer_id long, valid_from timestamp, name string, address string, is_snapshot int, is_deleted int, version long"
T1, T2, T3, T4 = (datetime(2026, 1, d) for d in (1, 2, 3, 4))
EPOCH = datetime(1970, 1, 1)


def built(spark, rows):
    df = scd2.build(spark.createDataFrame(rows, JOURNAL), "customer_id", ["name", "address"])
    return [(r["address"], r["valid_from"], r["valid_to"], r["is_current"]) for r in df.orderBy("customer_id", "version").collect()]


def test_snapshot_then_change(spark):
    assert built(spark, [(1, T1, "n", "Moscow", 1, 0, 10), (1, T2, "n", "Kazan", 0, 0, 20)]) == [("Moscow", EPOCH, T2, 0), ("Kazan", T2, None, 1)]


def test_no_change_opens_nothing(spark):
    assert built(spark, [(1, T1, "n", "A", 0, 0, 1), (1, T2, "n", "A", 0, 0, 2), (1, T3, "n", "B", 0, 0, 3)]) == [("A", T1, T3, 0), ("B", T3, None, 1)]


def test_order_by_version_not_clock(spark):
    assert built(spark, [(1, T3, "n", "A", 0, 0, 1), (1, T2, "n", "B", 0, 0, 2)]) == [("A", T3, T2, 0), ("B", T2, None, 1)]


def test_delete_and_again(spark):
    rows = [(1, T1, "n", "A", 0, 0, 1), (1, T2, "n", "A", 0, 1, 2)]
    assert built(spark, rows) == [("A", T1, T2, 0)]
    assert built(spark, [*rows, (1, T3, "n", "A", 0, 0, 3)]) == [("A", T1, T2, 0), ("A", T3, None, 1)]


def test_same_time_counts_once(spark):
    assert built(spark, [(1, T1, "n", "A", 0, 0, 1), (1, T1, "n", "B", 0, 0, 2)]) == [("B", T1, None, 1)]
    assert built(spark, []) == []


def test_many_keys(spark):
    rows = []
    for k in range(50):
        for v in range(3 + k % 2):
            rows.append((k, datetime(2026, 1, 1 + v), "n", f"a{v}", int(v == 0), int(k % 5 == 0 and v == 2 + k % 2), k * 10 + v))
    df = scd2.build(spark.createDataFrame(rows, JOURNAL), "customer_id", ["name", "address"])
    current = {r["customer_id"]: r["n"] for r in df.groupBy("customer_id").agg(F.sum("is_current").alias("n")).collect()}
    assert sum(v == 1 for v in current.values()) == 40 and sum(v == 0 for v in current.values()) == 10
    assert scd2.gaps(df, "customer_id").count() == 0


def test_latest_takes_deletes_before_hiding_them(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 5, 0), (2, 4, 1)], "id long, version long, is_deleted int")
    assert sorted((r["id"], r["version"]) for r in latest(df, ["id"], ["version"]).collect()) == [(1, 2), (2, 5)]
    assert [(r["id"], r["version"]) for r in latest_live(df, ["id"], ["version"]).collect()] == [(2, 5)]


def test_conflicts(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "a"), (2, 1, None), (3, 1, "x"), (3, 2, "y")], "id long, version long, s string")
    assert [r["id"] for r in conflicts(df, ["id", "version"], ["s"]).collect()] == [2]


def test_replay_summary(spark):
    log = [("a", "c", 1, 1), ("a", "u", 2, 2), ("a", "u", 3, 2), ("b", "r", 4, 3), ("b", "d", 5, 4)]
    r = replay_summary(spark.createDataFrame(log, "key string, op string, pos long, lsn long"), "key", "op", "pos", "lsn").first()
    assert r.asDict() == {"live_keys": 1, "n_c": 1, "n_u": 2, "n_d": 1, "n_r": 1, "duplicates": 1}


def test_asof_before_at_and_after(spark):
    us = [datetime(2026, 1, 1, 12, 0, 0, x) for x in (100, 300, 299, 301)]
    prices = spark.createDataFrame([(1, us[0], 10), (1, us[1], 12), (2, us[0], 5)], "product_id long, valid_from timestamp, price int")
    lines = [(1, 1, us[2]), (2, 1, us[1]), (3, 1, us[3]), (4, 1, datetime(2025, 1, 1)), (5, 9, us[0]), (6, None, us[0]), (7, 1, us[1])]
    left = spark.createDataFrame(lines, "id long, product_id long, at timestamp")
    want = {1: 10, 2: 12, 3: 12, 4: None, 5: None, 6: None, 7: 12}
    got = asof_left_join(left, prices, "product_id", "at", "valid_from", ["price"])
    assert got.columns == ["id", "product_id", "at", "price"] and {r["id"]: r["price"] for r in got.collect()} == want
    assert {r["price"] for r in asof_left_join(left, prices.where("price < 0"), "product_id", "at", "valid_from", ["price"]).collect()} == {None}


def asof_case(seed=3, old_version=True):
    """Two thirds of the lines are of key 0; with ``old_version`` one version of each key dates from 1970."""
    rng, t0 = random.Random(seed), datetime(2026, 1, 1)
    times = {k: sorted(rng.sample(range(100_000), rng.randrange(1, 30))) for k in range(12)}
    if old_version:
        times = {k: [-(t0 - datetime(1970, 1, 1)).days * 86_400, *ts] for k, ts in times.items()}
    versions = [(k, t0 + timedelta(seconds=t), t) for k, ts in times.items() for t in ts]
    lines = [(i, rng.choice([None, 13, *range(12)]) if i % 3 == 0 else 0, rng.randrange(-5000, 120_000)) for i in range(3000)]
    lines += [(9000 + i, 0, None) for i in range(3)]
    want = {i: None if t is None else max((x for x in times.get(k, []) if x <= t), default=None) for i, k, t in lines}
    return [(i, k, None if t is None else t0 + timedelta(seconds=t)) for i, k, t in lines], versions, want


@pytest.mark.parametrize("old_version", [False, True])
@pytest.mark.parametrize("spread", [False, True])
def test_asof_as_by_brute_force(spark, old_version, spread):
    lines, versions, want = asof_case(3, old_version)
    left = spark.createDataFrame(lines, "id long, k long, at timestamp")
    right = spark.createDataFrame(versions, "k long, since timestamp, v long")
    hot = hot_ranges(left, left, "k", "at", many=1000, ranges=8) if spread else None
    assert {r["id"]: r["v"] for r in asof_left_join(left, right, "k", "at", "since", ["v"], hot).collect()} == want


def test_a_hot_key_with_a_version_of_1970_is_spread(spark):
    lines, versions, _ = asof_case()
    left = spark.createDataFrame(lines, "id long, k long, at timestamp")
    right = spark.createDataFrame(versions, "k long, since timestamp, v long")
    hot = hot_ranges(left, left, "k", "at", many=1000, ranges=32)
    (row,) = hot.collect()
    assert row["_k"] == 0 and len(row["_bounds"]) == 31
    saved = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        joined = asof_left_join(left, right, "k", "at", "since", ["v"], hot)
        tasks = [r["count"] for r in joined.where("k = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.max("v")).collect()]
        assert len(tasks) > 8 and max(tasks) < 600 and sum(tasks) > 2000
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)


def test_no_key_is_hot_among_few_rows(spark):
    rows = spark.createDataFrame([(1, T1)] * 50 + [(None, T1)] * 500, "k long, at timestamp")
    assert hot_ranges(rows, rows, "k", "at") is None
    assert hot_ranges(rows, rows, "k", "at", many=100) is None
    assert hot_ranges(rows.limit(0), rows, "k", "at") is None
    (row,) = hot_ranges(rows, rows, "k", "at", many=40).collect()
    assert row["_k"] == 1 and len(row["_bounds"]) == 1


def test_asof_of_empty_sides(spark):
    left = spark.createDataFrame([(1, 1, T1)], "id long, k long, at timestamp")
    right = spark.createDataFrame([(1, T1, 5)], "k long, since timestamp, v long")
    assert [r["v"] for r in asof_left_join(left, right, "k", "at", "since", ["v"]).collect()] == [5]
    assert [r["v"] for r in asof_left_join(left, right.limit(0), "k", "at", "since", ["v"]).collect()] == [None]
    assert asof_left_join(left.limit(0), right, "k", "at", "since", ["v"]).collect() == []
