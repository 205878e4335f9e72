import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            s = sorted(((-int(q @ v), j) for j, v in ok if j != i))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in topk.op7_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_as_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 24)) / 5
    v[100:400] = v[100]  # a third of all rows are one vector
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1001, []), (1020, [None] * 24), (1040, [float("nan")] * 24), (1060, [float("inf")] + [0.0] * 23), (1080, [0.0] * 24)]
    got, want = run(spark, rows, tmp_path), brute(rows)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [(i, s) for _, i, s in got[q]] == w and [r for r, _, _ in got[q]] == list(range(1, len(w) + 1))


def test_blocks_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(rng.integers(-60, 60, size=(300, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    q = df.where("vec_id % 20 = 0")
    small = topk.top_k(q, df, k=5, block=40 * 12).collect()  # eight blocks
    assert sorted(small) == sorted(topk.top_k(q, df, k=5).collect())


def test_reading_stops_on_proof():
    """Vectors with a few large components: most postings are never read, and the results are exact."""
    rng = np.random.default_rng(3)
    v = rng.integers(-1, 2, size=(3000, 32))
    v[np.arange(3000), rng.integers(0, 32, 3000)] += rng.integers(200, 900, 3000)
    v = np.concatenate([v, v[:50]])
    ids = np.concatenate([np.arange(3000), np.arange(50)])
    order = np.argsort(ids, kind="stable")
    index = topk.ImpactIndex(v[order], ids[order])
    got = index.top(v[:40], np.arange(40), 10)
    for i, (at, score) in enumerate(got):
        s = v[order] @ v[i]
        want = sorted((-x, j) for j, x in enumerate(s) if ids[order][j] != i)[:10]
        assert list(zip((-score).tolist(), at.tolist())) == want
    assert index.read < index.held / 2


def test_numbers_of_any_size(spark):
    big = [2**20 + 1, 2**33 + 7, 2**61, -(2**62)]
    rows = [(i, [x, -x, 1]) for i, x in enumerate(big)] + [(20, [2**20 + 3, 5, 1]), (40, [3, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df.where("vec_id % 20 = 0"), df).collect()}
    pad = {i: v + [0] * (3 - len(v)) for i, v in rows}
    for q in (0, 20, 40):
        for j, v in pad.items():
            if j != q:
                exact = sum(a * b for a, b in zip(pad[q], v))
                assert got[q, j] == min(max(exact, -(2**63)), 2**63 - 1)


def test_few_and_none(spark, tmp_path):
    got = run(spark, [(0, [0.5]), (20, [0.25]), (20, [0.25]), (7, [0.5])], tmp_path / "a")
    assert [(i, s) for _, i, s in got[0]] == [(7, 1024), (20, 512), (20, 512)]
    assert run(spark, [], tmp_path / "b") == {}


def test_every_task_has_one_block(spark):
    """Blocks are dealt by their number, so no task has two while another has none."""
    from pyspark.sql import functions as F

    rows = spark.range(600).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(9)) - 4).alias("v"))
    hits = topk.top_k(rows.where("vec_id % 20 = 0"), rows, 5, block=300)
    assert hits.count() == 30 * 5
    parts = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("vb")).repartitionById(16, "vb")
    assert sorted(r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.count_distinct("vb").alias("n")).collect()) == [1] * 16
