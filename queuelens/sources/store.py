"""Partitioned Parquet fact store (one folder per fact, ``year=`` partitions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INPATIENT_SCHEMA = T.StructType([
    T.StructField("archive_date", T.DateType(), False),
    T.StructField("specialty_hipe", T.IntegerType(), True),
    T.StructField("specialty_name", T.StringType(), False),
    T.StructField("case_type", T.StringType(), True),
    T.StructField("adult_child", T.StringType(), True),
    T.StructField("age_profile", T.StringType(), True),
    T.StructField("time_bands", T.StringType(), True),
    T.StructField("total", T.IntegerType(), False),
    T.StructField("year", T.IntegerType(), False),
])
OUTPATIENT_SCHEMA = T.StructType([f for f in INPATIENT_SCHEMA.fields if f.name != "case_type"])
DIM_SCHEMA = T.StructType([
    T.StructField("specialty_name", T.StringType(), False),
    T.StructField("specialty_group", T.StringType(), False),
])


def write_fact_store(df: DataFrame, path: str, mode: str = "overwrite",
                     max_records_per_file: int = 20_000_000) -> None:
    """Write a fact partitioned by year.

    No repartition by year: one year may hold a large share of all rows, and
    hashing on it would funnel that share into one task. Each task writes its
    own rows (the writer sorts them by year locally), capped per file.
    """
    (df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
       .partitionBy("year").parquet(path))


def read_fact_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a fact with its declared schema; ``year`` filters prune partitions."""
    return spark.read.schema(schema).parquet(path)
