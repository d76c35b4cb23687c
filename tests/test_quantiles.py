"""Percentiles by ranges against the built-in aggregate, which holds all values in one task."""

import random

import pytest
from pyspark.sql import functions as F

from queuelens.operators.distribution import CNT, percentiles, value_counts
from queuelens.operators.quantiles import wide_percentiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.98, 1.0]


def both(vc, keys, ranges):
    got = wide_percentiles(vc, keys, "v", PROBS, ranges=ranges)
    assert got.columns == percentiles(vc, keys, "v", PROBS).columns
    return sorted(map(tuple, got.collect())), sorted(map(tuple, percentiles(vc, keys, "v", PROBS).collect()))


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_equal_to_percentile(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice("aaaab"), i % 3, rng.choice([rng.randint(-50, 50), rng.randint(0, 10**9), 7])) for i in range(4000)]
    rows += [("c", 0, 5), ("d", 0, 1), ("d", 0, 2), ("d", 1, 3), (None, 0, 1), ("e", 0, None)]
    vc = value_counts(spark.createDataFrame(rows, "k string, j int, v long"), ["k", "j"], "v")
    got, want = both(vc, ["k", "j"], ranges)
    assert got == want and len(got) == 9


def test_doubles_and_empty(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("x", rng.gauss(0, 1)) for _ in range(3001)], "k string, v double")
    got, want = both(value_counts(df, ["k"], "v"), ["k"], 16)
    assert got == want
    assert wide_percentiles(value_counts(df.limit(0), ["k"], "v"), ["k"], "v", PROBS).collect() == []


def test_all_values_distinct_and_one_hot_key(spark):
    df = spark.range(400_000).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("k"),
                                     (F.col("id") * 7919 % 400_009).alias("v"), F.lit(1).cast("long").alias(CNT))
    got, want = both(df, ["k"], 128)
    assert got == want
