"""One lazy pass over the rows for plans that need them at several grains.

``GROUPING SETS`` sums the rows at every grain in one aggregation with one
shuffle. Each grain is then a selection from its result. Were that an
ordinary filter and projection, the planner would push each grain's down to
the scan and read the facts once per grain; so the result is packed into one
column beside a mark that no rule moves, all grains keep one and the same
plan below it, and its shuffle runs once and is reused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import measures as M
from queuelens.operators.distribution import CNT

VALUE = "value"        # grouping key: the row's own total


@dataclass
class Grain:
    """Sums at one grain; stands in for the rows in plans that only add up ``total``."""

    frame: DataFrame   # the keys, total, records; wait_rank and band_rank where the band is a key

    def combined(self) -> DataFrame:
        return self.frame


def grains(rows: DataFrame, **keys: list[str]) -> dict[str, Grain]:
    """The sums of ``rows`` at each named grain, from one read of them."""
    names = list(dict.fromkeys(k for ks in keys.values() for k in ks))
    summed = (rows.withColumn(VALUE, F.col("total"))
              .groupingSets([[F.col(k) for k in ks] for ks in keys.values()], *[F.col(k) for k in names])
              .agg(F.grouping_id().alias("_set"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("records")))
    packed = summed.select(F.struct("*", F.spark_partition_id().alias("_mark")).alias("_row"))
    out = {}
    for grain, ks in keys.items():
        absent = sum(1 << (len(names) - 1 - i) for i, k in enumerate(names) if k not in ks)
        frame = packed.filter(F.col("_row._set") == absent).select(*(f"_row.{c}" for c in (*ks, "total", "records")))
        if "time_bands" in ks:
            frame = frame.select("*", M.wait_rank().alias("wait_rank"), M.band_rank().alias("band_rank"))
        out[grain] = Grain(frame)
    return out


def value_counts(values: Grain, key: str) -> DataFrame:
    """(key, total, cnt) from a grain with the key and the rows' own totals."""
    return values.frame.groupBy(key, F.col(VALUE).alias("total")).agg(F.sum("records").alias(CNT))


def mean_wait() -> Column:
    """Mean wait ordinal over records, null ordinals skipped."""
    ranked = F.col("wait_rank").isNotNull()
    return F.try_divide(F.sum(F.col("wait_rank") * F.col("records")).cast("double"),
                        F.sum(F.when(ranked, F.col("records"))).cast("double"))
