"""Prefix scan over ranges against windows that gather everything in one task."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.operators.ordered import scan


def _windows(df, order):
    w = W.orderBy(*order)
    return df.select("*", F.rank().over(w).alias("r"), F.sum("v").over(w).alias("s"), F.lag("v").over(w).alias("p"))


@pytest.mark.parametrize("order", [["k"], ["-k"], ["name", "k"]])
def test_scan_equals_plain_windows(spark, order):
    rows = [(i * 7919 % 5003, f"n{i % 50:02d}", i % 13 if i % 11 else None) for i in range(5003)]
    df = spark.createDataFrame(rows, "k int, name string, v int")
    by = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
    got = scan(df, by, rank="r", running={"s": "v"}, lag={"p": "v"}, ranges=7)
    assert got.columns == ["k", "name", "v", "r", "s", "p"]
    assert sorted(map(str, got.collect())) == sorted(map(str, _windows(df, by).collect()))


def test_ties_nulls_and_empty_ranges(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, None), (3, 4), (3, 5), (9, 6)], "k int, v int")
    got = {(r.k, r.v): (r.r, r.s) for r in scan(df, [F.asc("k")], rank="r", running={"s": "v"}, ranges=50).collect()}
    assert got == {(None, 1): (1, 3), (None, 2): (1, 3), (3, None): (3, 12), (3, 4): (3, 12), (3, 5): (3, 12), (9, 6): (6, 18)}
    numbers = [r.n for r in scan(df, [F.asc("k"), F.asc("v")], row_number="n", ranges=3).collect()]
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert scan(df.limit(0), [F.asc("k")], rank="r", lag={"p": "v"}).collect() == []


def test_rows_are_not_gathered_and_shuffled_by_range_once(spark):
    df = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("v"))
    got = scan(df, [F.desc("k")], rank="r", running={"s": "v"}, lag={"p": "v"}, ranges=8)
    assert got.agg(F.sum("r"), F.max("s"), F.sum("p")).first()[:] == (200_000 * 200_001 // 2, 900_000, 900_000)
    plan = got._jdf.queryExecution().executedPlan()
    final = plan.toString()
    single = [ln for ln in final.split("\n") if "Exchange SinglePartition" in ln]
    assert len(single) <= 1                                     # the summary: a row per range


def test_reports_gather_only_summaries(spark):
    from queuelens.plans.registry import all_plans
    for name in ("specialty_volume_risk", "mom_shock"):
        plan = all_plans()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
        for i, line in enumerate(plan):
            if "Exchange SinglePartition" in line:
                assert any("keys=[_range" in below or "key=[_range" in below for below in plan[i:i + 4]), (name, plan[i:i + 4])
