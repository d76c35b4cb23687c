"""Exact distinct counts that merge: bitmaps over dictionary ids.

A count of distinct values cannot be added up over years or types. Here each
value has an id from a dictionary, and a key's values are the bits of its ids,
32,768 to a row of 4 kB. Bitmaps merge by "or", so every coarser grain, and
what was counted before plus what is new, follow from the finest ones without
the values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.operators.ordered import scan

BUCKET, BITS = "_bucket", "_bits"


def bitmaps(rows: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """(keys, bucket, bits): the distinct non-null ``value`` of each key, null keys being keys of their own.

    The rows are read once: (keys, value) cells are made in one aggregation,
    which the dictionary and the bitmaps share. Ids are places in the order
    of the values, found range by range, so no task holds all values.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # packed beside a mark that no rule moves, so that both uses keep one plan below
    packed = cells.select(F.struct("*", F.spark_partition_id().alias("_mark")).alias("_row"))
    values = packed.select(F.col(f"_row.{value}").alias("_value")).distinct()
    ids = scan(values, [F.col("_value")], row_number="_id", ranges=ranges)
    placed = (packed.select(*(F.col(f"_row.{c}").alias(c) for c in (*keys, value)))
              .join(ids, F.col(value) == F.col("_value")))
    return (placed.groupBy(*keys, F.bitmap_bucket_number("_id").alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias(BITS)))


def merged(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of one dictionary put together at the grain of ``keys``."""
    return reduce(DataFrame.unionByName, (p.select(*keys, BUCKET, BITS) for p in parts)).groupBy(
        *keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def rolled_up(maps: DataFrame, sets: list[list[str]], name: str) -> DataFrame:
    """Distinct counts at each grain of ``sets`` from one set of bitmaps: keys, ``grain``, ``name``.

    ``grain`` is the grouping id: a bit per key, the first key's highest, set
    where the key is rolled up. A grain without any value has no row.
    """
    keys = list(dict.fromkeys(k for ks in sets for k in ks))
    names: list[Column] = [F.col(k) for k in keys]
    ored = (maps.groupingSets([[*(F.col(k) for k in ks), F.col(BUCKET)] for ks in sets], *names, F.col(BUCKET))
            .agg(F.shiftright(F.grouping_id(), 1).alias("grain"), F.bitmap_or_agg(BITS).alias(BITS)))
    return ored.groupBy(*keys, "grain").agg(F.sum(F.bitmap_count(BITS)).alias(name))
