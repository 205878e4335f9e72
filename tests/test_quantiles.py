import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import bin_of, exact_quantiles


def plainly(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize("seed", range(4))
def test_against_sorted_values(spark, seed):
    rng = random.Random(seed)
    draws = [lambda: rng.randrange(10), lambda: rng.randrange(-(10**6), 10**9), lambda: int(rng.lognormvariate(5, 4)), lambda: 7, lambda: rng.choice([-1, 0, 2**50])]
    rows = [(g, "x" if g % 2 else None, rng.choice(draws)(), rng.choice([None, rng.randrange(1000)])) for g in range(9) for _ in range(1 + rng.randrange(300))]
    rows += [(50, "y", None, 3), (51, "z", None, None)]
    df = spark.createDataFrame(rows, "g int, h string, a long, b long")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["g"], r["h"]): r for r in exact_quantiles(df, ["g", "h"], {"a": F.col("a"), "b": F.col("b")}, shares).collect() if r["h"] is not None}
    keys = {(g, h) for g, h, a, b in rows if h is not None and (a, b) != (None, None)}
    assert set(got) == keys
    for key in keys:
        for i, name in ((2, "a"), (3, "b")):
            values = [r[i] for r in rows if r[:2] == key and r[i] is not None]
            for p in shares:
                assert got[key][f"{name}_{p}"] == (pytest.approx(plainly(values, p)) if values else None)


def test_bins_follow_the_values(spark):
    values = sorted({s * v for v in [0, 1, 2, 3, 9, 10, 11, 99, 1000, 10**6, 10**12, 2**62] for s in (1, -1)})
    got = [r["bin"] for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", bin_of(F.col("v")).alias("bin")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_nothing_holds_a_group(spark):
    """A single group of many values is counted, binned and sorted by several tasks; no percentile buffer is in the plan."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 37 % 10_007).alias("v"))
    out = exact_quantiles(df, ["g"], {"v": F.col("v")}, (0.5,))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    want = plainly([i * 37 % 10_007 for i in range(20_000)], 0.5)
    assert out.first()["v_0.5"] == want
