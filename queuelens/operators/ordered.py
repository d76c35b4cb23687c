"""Rank, running sum and lag over one long order, without gathering it in one task.

A window without partition keys sends every row to a single task. Here rows
are dealt to ranges of the order (equal keys share a range), each range is
numbered, summed and lagged by itself, and what earlier ranges add up to is
carried over from a summary of one row per range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

RANGE = "_range"


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of ``order``, with the range's number.

    The number is packed with the row beside it, so that every use of the
    result has one and the same plan below, whose shuffle runs once: two
    shuffles would draw two samples and might cut at other places.
    """
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = df.repartitionByRange(count, *order).select(
        F.struct("*", F.spark_partition_id().alias(RANGE)).alias("_row"))
    return packed.select("_row.*")


def scan(df: DataFrame, order: list[Column], rank: str | None = None, row_number: str | None = None,
         running: Mapping[str, str] | None = None, lag: Mapping[str, str] | None = None,
         ranges: int | None = None) -> DataFrame:
    """``df`` with its rank, row number, running sums and previous values in ``order``.

    ``running`` and ``lag`` map new names to columns. Results are those of
    windows without partition keys; rows that tie in ``order`` have one rank,
    and share the running sum of the last of them. No task holds more than a
    range of rows, so only a key that ties with a large share of all rows
    makes a large range. The summary has a row per range and is broadcast.
    """
    running, lag = dict(running or {}), dict(lag or {})
    own = W.partitionBy(RANGE).orderBy(*order)
    inside = ranged(df, order, ranges).select(
        "*", F.row_number().over(own).alias("_place"), F.rank().over(own).alias("_rank"),
        *(F.sum(c).over(own).alias(f"_sum_{name}") for name, c in running.items()),
        *(F.lag(c).over(own).alias(f"_lag_{name}") for name, c in lag.items()))
    last = F.max(F.struct("_place", *(F.col(c).alias(f"_last_{name}") for name, c in lag.items())))
    summary = inside.groupBy(RANGE).agg(
        F.count(F.lit(1)).alias("_n"), last.alias("_end"), *(F.sum(c).alias(f"_all_{name}") for name, c in running.items()))
    earlier = W.orderBy(RANGE)                                  # a row per range
    upto = earlier.rowsBetween(W.unboundedPreceding, -1)
    before = summary.select(
        F.col(RANGE).alias("_of"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.lag("_end").over(earlier).alias("_end"),
        *(F.sum(f"_all_{name}").over(upto).alias(f"_before_{name}") for name in running))
    joined = inside.join(F.broadcast(before), F.col(RANGE) == F.col("_of"))
    out = [F.col(c) for c in df.columns]
    if row_number:
        out.append((F.col("_place") + F.col("_before")).alias(row_number))
    if rank:
        out.append((F.col("_rank") + F.col("_before")).alias(rank))
    for name in running:
        here, carried = F.col(f"_sum_{name}"), F.col(f"_before_{name}")
        # a sum over nulls only is null, as in a window
        out.append(F.coalesce(here + carried, here, carried).alias(name))
    for name in lag:
        out.append(F.when(F.col("_place") == 1, F.col(f"_end._last_{name}")).otherwise(F.col(f"_lag_{name}")).alias(name))
    return joined.select(*out)
