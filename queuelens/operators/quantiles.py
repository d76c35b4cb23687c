"""Exact percentiles of a wide domain, where no task holds all distinct values.

The ``percentile`` aggregate keeps a map of all distinct values of a key in
one task. Here a mergeable sketch of bounded size cuts every key's values
into ranges, counts per range tell exactly which range holds a wanted rank,
and only the values of those ranges are put in order. The sketch decides how
even the ranges are and never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from queuelens.operators.distribution import CNT


def _range_of(value: Column, cuts: str, ranges: int) -> Column:
    """How many of the ordered ``cuts`` are below ``value``, by halving."""
    steps = [F.lit(1 << s) for s in reversed(range(ranges.bit_length()))]
    return F.aggregate(
        F.array(*steps), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(F.col(cuts), at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys; the right side's are dropped."""
    there = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = reduce(Column.__and__, (F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)))
    return left.join(there, on).drop(*(f"_k{i}" for i in range(len(keys))))


def wide_percentiles(vc: DataFrame, keys: list[str], value: str, probs: list[float], prefix: str = "p",
                     ranges: int = 1024) -> DataFrame:
    """Linear-interpolation percentiles per key from a value-count table; equal to ``percentile``.

    A task holds one range of a key: about a ``ranges``-th of its distinct
    values. Per key the sketch leaves ``ranges`` cuts, the counts as many
    rows. The value-count table has one plan for both of its uses, so its
    shuffle runs once. Null keys and values are left out, as in
    ``value_counts``; an empty table gives no rows.
    """
    if not keys or not probs or ranges < 2:
        raise ValueError("keys, probs and at least two ranges are needed")
    # one SQL text: a call to the JVM per mark would take longer than the rest of the plan
    marks = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    cuts = vc.groupBy(*keys).agg(F.expr(f"percentile_approx(`{value}`, array({marks}), {8 * ranges})").alias("_cuts"),
                                 F.sum(CNT).alias("_n"))
    positions = F.array(*(F.lit(float(p)) * (F.col("_n") - 1) for p in probs))
    ranks = F.array_distinct(F.flatten(F.transform(positions, lambda at: F.array(F.floor(at), F.ceil(at)))))
    cuts = cuts.select(*keys, F.array_distinct("_cuts").alias("_cuts"), "_n", ranks.alias("_ranks"))
    placed = _match(vc, cuts, keys).withColumn("_range", _range_of(F.col(value), "_cuts", ranges)).drop("_cuts")
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = (placed.groupBy(*keys, "_range").agg(F.sum(CNT).alias("_here"), F.first("_ranks").alias("_all"))
            .select("*", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before")))
    held = held.select(
        *keys, "_range", "_before",
        F.filter("_all", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_here"))).alias("_wanted"))
    inside = _match(placed.drop("_ranks"), held.filter(F.size("_wanted") > 0), [*keys, "_range"])
    upto = F.col("_before") + F.sum(CNT).over(W.partitionBy(*keys, "_range").orderBy(value))
    found = inside.select("*", upto.alias("_upto")).select(
        *keys, "_n", F.col(value).cast("double").alias("_value"),
        F.explode(F.filter("_wanted", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col(CNT)))).alias("_rank"))
    per_key = found.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def between(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col("_at")[F.floor(at)], F.col("_at")[F.ceil(at)]
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return per_key.select(*keys, *(between(p).alias(f"{prefix}{i}") for i, p in enumerate(probs)))
