import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import capture
from tidemark.operators.versions import latest_live

JOURNAL = "k long, v string, version long, is_snapshot int, is_deleted int"


class Source:
    """A table that changes: a log of (key, value or none) by position, of which reading takes part while it goes on."""

    def __init__(self, seed, keys=40, changes=400):
        rng = random.Random(seed)
        self.log = [(rng.randrange(keys), rng.choice([None, f"v{i}", f"v{i}", f"v{i}"])) for i in range(changes)]
        self.now, self.rng = 60, rng

    def position(self):
        return self.now - 1

    def state(self):
        held = {}
        for k, v in self.log[: self.now]:
            held[k] = v
        return {k: v for k, v in held.items() if v is not None}

    def move(self):
        self.now = min(len(self.log), self.now + self.rng.randrange(25))

    def read(self, spark):
        """Changes come before the read, and after it before the position is asked for again."""

        def at(bounds):
            self.move()
            rows = [(k, v) for k, v in self.state().items()]
            self.move()
            return capture.in_range(spark.createDataFrame(rows, "k long, v string"), "k", bounds)

        return at

    def tail(self, spark):
        rows = [(k, v, i, 0, int(v is None)) for i, (k, v) in enumerate(self.log)]
        return spark.createDataFrame(rows, JOURNAL)


def live(df):
    return sorted((r["k"], r["v"]) for r in latest_live(df, ["k"], ["version", "is_snapshot"]).collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_plain_replay(spark, tmp_path, seed):
    source = Source(seed)
    ranges = capture.key_ranges(spark.range(40).withColumnRenamed("id", "k"), "k", 5)
    assert len(ranges) == 5 and ranges[0][0] is None and ranges[-1][1] is None
    shot = capture.Snapshot(spark, f"{tmp_path}/s")
    assert shot.run(ranges, source.read(spark), source.position) == 5
    assert source.now > 80  # there were changes meanwhile
    journal = capture.handed_over(shot.rows(), source.tail(spark), ["k"])
    source.now = len(source.log)
    assert live(journal) == sorted(source.state().items())
    assert journal.columns == ["k", "v", "version", "is_snapshot", "is_deleted"]
    assert journal.where("is_snapshot = 0").agg(F.min("version")).first()[0] > shot.start()


def test_what_changed_meanwhile_comes_from_the_tail_only(spark):
    rows = spark.createDataFrame([(1, "before or after", 10, 20), (2, "quiet", 10, 20), (3, "moved earlier", 10, 20), (4, "moves later", 10, 20), (None, "no key", 10, 20)], "k long, v string, _low long, _high long")
    tail = spark.createDataFrame([(1, "new", 15, 0, 0), (3, "old", 10, 0, 0), (4, "then", 21, 0, 0), (2, "at first", 3, 0, 0)], JOURNAL)
    got = sorted(map(tuple, capture.handed_over(rows, tail, ["k"]).collect()), key=str)
    assert got == sorted([(2, "quiet", 20, 1, 0), (3, "moved earlier", 20, 1, 0), (4, "moves later", 20, 1, 0), (None, "no key", 20, 1, 0), (1, "new", 15, 0, 0), (4, "then", 21, 0, 0)], key=str)


def test_goes_on_behind_the_last_whole_chunk(spark, tmp_path):
    ranges = [(None, 10), (10, 20), (20, None)]
    data = spark.range(30).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    calls = []

    def failing(bounds):
        calls.append(bounds)
        if len(calls) == 2:
            raise RuntimeError("the source went away")
        return capture.in_range(data, "k", bounds)

    clock = iter(range(100))
    shot = capture.Snapshot(spark, f"{tmp_path}/s")
    with pytest.raises(RuntimeError):
        shot.run(ranges, failing, lambda: next(clock))
    again = capture.Snapshot(spark, f"{tmp_path}/s")
    assert again.run(ranges, failing, lambda: next(clock)) == 2
    assert calls == [ranges[0], ranges[1], ranges[1], ranges[2]]
    assert sorted(r["k"] for r in again.rows().collect()) == list(range(30))
    assert again.run(ranges, failing, lambda: next(clock)) == 0
    with pytest.raises(ValueError):
        again.run([(None, None)], failing, lambda: next(clock))


def test_ranges_of_an_empty_or_small_table(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert capture.key_ranges(empty, "k", 4) == [(None, None)]
    assert capture.key_ranges(spark.range(1).withColumnRenamed("id", "k"), "k", 4)[0][0] is None
    assert capture.key_ranges(spark.range(9).withColumnRenamed("id", "k"), "k", 1) == [(None, None)]
