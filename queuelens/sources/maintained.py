"""Summaries kept per year beside a snapshot store; only changed years are recomputed.

A summary is a store of its own (``sources/snapshots``) whose rows name the
folder of facts they were made from. A refresh compares these names with the
facts' manifest, summarises the years that differ, drops years that are gone,
and publishes both in one step: readers see the summary before or after it.
Reports then add up what the years keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.sources.snapshots import manifest, publish, read_snapshot, versions

SOURCE = "made_from"
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"        # the folder of null years


def cube(keys: list[str], value: str = "total") -> Callable[[DataFrame], DataFrame]:
    """Per year and ``keys``: records, sum and sum of squares of ``value`` and its range; all add up over years."""
    def summarise(facts: DataFrame) -> DataFrame:
        v = F.col(value)
        square = v.cast("decimal(19,0)") * v.cast("decimal(19,0)")
        return facts.groupBy("year", *keys).agg(
            F.count(F.lit(1)).alias("records"), F.count(v).alias("counted"), F.sum(v.cast("long")).alias(value),
            F.sum(square).cast("decimal(38,0)").alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"))
    return summarise


def over(summary: DataFrame, keys: list[str], value: str = "total") -> DataFrame:
    """A cube's rows added up to ``keys``, with the mean and the sample variance of ``value`` (null below two)."""
    n, s = F.col("counted").cast("double"), F.col(value).cast("double")
    added = summary.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("records", "counted", value, "squares")),
        F.min("least").alias("least"), F.max("most").alias("most"))
    # n * squares - sum^2 in integers, as the difference of doubles may cancel; doubles where 38 digits are too few
    whole = F.col(value).cast("decimal(19,0)")
    exact = F.try_subtract(F.try_multiply(F.col("counted").cast("decimal(19,0)"), F.col("squares").cast("decimal(38,0)")),
                           F.try_multiply(whole, whole)).cast("double")
    spread = F.coalesce(exact, n * F.col("squares").cast("double") - s * s)
    variance: Column = F.try_divide(spread, n * (n - 1))
    return added.select(*keys, "records", value, "least", "most", F.try_divide(s, n).alias("mean"), variance.alias("variance"))


def _schema(spark: SparkSession, schema: T.StructType, summarise: Callable[[DataFrame], DataFrame]) -> T.StructType:
    return T.StructType([*summarise(spark.createDataFrame([], schema)).schema.fields, T.StructField(SOURCE, T.StringType())])


def read_summary(spark: SparkSession, state: str, schema: T.StructType,
                 summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summary as last refreshed; empty before the first refresh."""
    return read_snapshot(spark, state, _schema(spark, schema, summarise)).drop(SOURCE)


def refresh(spark: SparkSession, facts: str, state: str, schema: T.StructType,
            summarise: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Bring the summary in ``state`` up to the latest version of ``facts``; the years that were read.

    ``schema`` is that of the facts. ``summarise`` keeps ``year`` and gives a
    row at least for a year with rows; one without is read again each time.
    Only a name per year reaches the driver.
    """
    there = versions(spark, facts)
    batches = manifest(spark, facts, there[-1]) if there else {}
    kept = read_snapshot(spark, state, _schema(spark, schema, summarise))
    have = {r[SOURCE] for r in kept.select(SOURCE).distinct().collect()}
    stale = sorted(y for y, b in batches.items() if f"{y}/{b}" not in have)
    gone = sorted({name.split("/")[0] for name in have} - set(batches))
    if stale or gone:
        read = read_snapshot(spark, facts, schema, there[-1] if there else None, years=stale)
        year = F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR))
        names = [F.lit(x) for y in stale for x in (y, f"{y}/{batches[y]}")]
        source = F.try_element_at(F.create_map(*names), year) if names else F.lit(None).cast("string")
        publish(summarise(read).withColumn(SOURCE, source), state, [*stale, *gone])
    return stale
