"""What the near-duplicates stage asks of the driver: no broadcast where no key is hot, each table counted once."""

from pyspark.sql import functions as F

from tidemark.llm import neardup
from tidemark.llm.common import joined_by_sorting, rows_in, saved


def _pairs(spark):
    many = spark.range(3000).select((F.when(F.col("id") < 1000, 7).otherwise(F.col("id"))).cast("long").alias("k"), F.col("id").alias("c"))
    one = many.groupBy("k").agg(F.min("c").alias("hub"), F.count("*").alias("size"))
    return many, one


def test_hot_keys_come_as_a_list_and_joins_are_the_same(spark):
    many, one = _pairs(spark)
    hot = neardup._hot(one, "k", 3000)
    assert hot == [7] and neardup._hot(one, "k", 200) == [] and neardup._hot(one.where("k <> 7"), "k", 3000) == []
    dealt = neardup._met(many, one, "k", hot, "c")
    assert sorted(dealt.collect()) == sorted(neardup._met(many, one, "k", [], "c").collect())
    assert dealt.count() == 3000 and dealt.columns == ["k", "c", "hub", "size"]


def test_no_broadcast_in_the_small_rounds(spark):
    many, one = _pairs(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with joined_by_sorting(spark):
        for hot in ([], [7]):
            met = neardup._met(many, one, "k", hot, "c")
            met.collect()
            assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_a_written_table_is_counted_once(spark):
    df = saved(spark.range(5), "five")
    assert rows_in(df) == 5
    df.count = None
    assert rows_in(df) == 5
