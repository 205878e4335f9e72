import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile

CUT, NOW = "2026-01-10", "2026-01-11"


def side(spark, rows):
    df = spark.createDataFrame([(k, v, at) for k, (v, at) in rows.items()], "k long, v string, at string").withColumn("at", F.col("at").cast("timestamp"))
    return reconcile.Side(df, F.col("k"), (F.col("k"), F.col("v")), F.col("at"))


def plainly(source, target):
    out = {}
    for k in source.keys() | target.keys():
        s, t = source.get(k), target.get(k)
        if (s and s[0]) != (t and t[0]):
            hot = any(x and x[1] and x[1] >= CUT for x in (s, t))
            out[k] = "in_flight" if hot else "missing" if t is None else "extra" if s is None else "different"
    return out


def made(seed, n, faults, fresh=0):
    rng = random.Random(seed)
    keys = rng.sample(range(-(10**9), 10**9), n)
    source = {k: (f"v{k % 7}", "2026-01-01") for k in keys}
    target = dict(source)
    for i, k in enumerate(rng.sample(keys, faults)):
        if i % 3 == 0:
            del target[k]
        elif i % 3 == 1:
            target[k] = ("other", None if i % 2 else "2026-01-02")
        else:
            del source[k]
    for k in rng.sample(sorted(source.keys() & target.keys()), fresh):
        target[k] = ("newer", NOW)
    return source, target


def cut():
    return F.lit(CUT).cast("timestamp")


@pytest.mark.parametrize("n, faults, fresh", [(0, 0, 0), (1, 1, 0), (500, 0, 0), (3000, 9, 5), (3000, 900, 50), (300, 300, 0)])
@pytest.mark.parametrize("nodes", [reconcile.NODES, 3])
def test_verdicts_against_plain_python(spark, monkeypatch, n, faults, fresh, nodes):
    monkeypatch.setattr(reconcile, "NODES", nodes)
    source, target = made(1, n, faults, fresh)
    got = reconcile.differences(side(spark, source), side(spark, target), cut(), compare_all=True, enough=2)
    assert {r["k"]: r["verdict"] for r in got.collect()} == plainly(source, target)


def test_fresh_changes_alone_open_no_node(spark):
    source, target = made(2, 400, 0, 20)
    old = {k: v for k, v in source.items() if target[k] == v}
    level, nodes = reconcile.differing_nodes(side(spark, old), side(spark, target), cut())
    assert (level, nodes) == (1, [])
    assert reconcile.differences(side(spark, old), side(spark, target), cut()).collect() == []


def test_keys_read_grow_with_the_differences(spark):
    n, read = 20_000, {}
    for faults in (0, 3, 30, 300):
        source, target = (side(spark, x) for x in made(3, n, faults))
        level, nodes = reconcile.differing_nodes(source, target, enough=4)
        read[faults] = reconcile.rows_of_nodes(source, level, nodes).count()
        flat = reconcile.differing(reconcile.buckets(source, None), reconcile.buckets(target, None)).count()
        if faults == 300:
            assert flat > 150  # most of the flat buckets differ, and would be read whole
    assert read[0] == 0 and read[3] <= 12 and read[30] <= 120 and read[300] <= 1200 < n // 10


def test_batches_of_buckets_read_their_rows_once(spark):
    source, target = made(4, 2000, 60, 5)
    parts = list(reconcile.compared(side(spark, source), side(spark, target), cut(), at_once=16))
    assert len(parts) > 1
    got = {}
    for part in reconcile.compared(side(spark, source), side(spark, target), cut(), at_once=16):
        got |= {r["k"]: r["verdict"] for r in part.collect()}
    want = plainly(source, target)
    assert {k: v for k, v in want.items() if v != "in_flight"} == {k: v for k, v in got.items() if v != "in_flight"}


def test_all_buckets_are_compared_in_one_frame(spark):
    """A frame reads both sides when it runs, so many frames put together would read them as often."""
    source, target = made(4, 2000, 300, 5)
    frame, *more = reconcile.compared(side(spark, source), side(spark, target), cut())
    assert not more
    got = {r["k"]: r["verdict"] for r in frame.collect()}
    assert {k: v for k, v in plainly(source, target).items() if v != "in_flight"} == {k: v for k, v in got.items() if v != "in_flight"}
