import random

import pytest
from pyspark.sql import functions as F

from codexfold.functions.prefix import STRIPS, _strip_and_block, prefix
from codexfold.functions.skew import lookup_join


def rows(seed, hot=True):
    rng = random.Random(seed)
    out = []
    for key in "abc":
        for order in rng.sample(range(-50, 5000), 700 if hot and key == "a" else 40):
            out.append((key, order, rng.randrange(100)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot_rows", [1, 39, 650, 10**6])
def test_prefix_equals_loop(spark, hot_rows):
    data = rows(hot_rows)
    df = spark.createDataFrame(data, "k string, o bigint, v bigint").repartition(7)
    got = prefix(df, ["k"], "o", {"s": ("sum", F.col("v")), "m": ("max", F.struct("o", "v"))}, hot_rows)
    assert got.columns == ["k", "o", "v", "s", "m"]
    expected, total, last = {}, {}, {}
    for k, o, v in sorted(data):
        expected[k, o] = (v, total.get(k, 0), last.get(k))
        total[k] = total.get(k, 0) + v
        last[k] = (o, v)
    result = {(r.k, r.o): (r.v, r.s, tuple(r.m) if r.m else None) for r in got.collect()}
    assert result == expected


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_prefix_over_two_order_columns(spark, hot_rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 0, 9), ("a", 0, 3), ("b", 1, 0)], "k string, src int, o bigint")
    got = prefix(df, ["k"], ["src", "o"], {"n": ("sum", F.lit(1))}, hot_rows).collect()
    assert {(r.k, r.src, r.o): r.n for r in got} == {
        ("a", 0, 3): 0, ("a", 0, 9): 1, ("a", 1, 5): 2, ("b", 1, 0): 0
    }


@pytest.mark.parametrize("hot_rows", [1, 100, 10**6])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how, hot_rows):
    large = spark.createDataFrame([("hot" if i % 3 else f"k{i % 11}", i) for i in range(500)], "k string, i int")
    unique = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, x int")
    ours = lookup_join(large, unique, ["k"], F.col("i"), how, hot_rows).select(*large.join(unique, "k", how).columns)
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, large.join(unique, "k", how).collect()))


def test_hot_key_is_spread(spark):
    """A key with most of the rows reaches many partitions of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        large = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
        unique = spark.createDataFrame([("hot", 1)], "k string, x int")
        sizes = (
            lookup_join(large, unique, ["k"], F.col("i"), hot_rows=1_000).groupBy(F.spark_partition_id()).count().collect()
        )
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bursts_are_cut_evenly(spark):
    """Nine tenths of a hot group in a hundredth of its range still reach many blocks."""
    burst = spark.range(18_000).select((F.col("id") + 500_000).alias("o"))
    df = burst.union(spark.range(2_000).select(F.col("id") * 900)).distinct().withColumn("k", F.lit("a"))
    cuts = df.agg(F.percentile_approx("o", [k / STRIPS for k in range(STRIPS + 1)]).alias("cuts"))
    placed = df.crossJoin(cuts).select("o", *_strip_and_block(F.col("o"), F.col("cuts"), F.lit(256.0)))
    cells = placed.groupBy("_strip", "_number").agg(F.count("*").alias("n"), F.min("o").alias("least")).collect()
    assert max(c.n for c in cells) < 20_000 / 64
    ordered = sorted(cells, key=lambda c: (c["_strip"], c["_number"]))
    assert [c.least for c in ordered] == sorted(c.least for c in cells)
    total = prefix(df, ["k"], "o", {"n": ("sum", F.lit(1))}, hot_rows=1_000)
    assert [r.n for r in total.orderBy("o").collect()] == list(range(df.count()))
