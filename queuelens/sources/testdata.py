"""Canonical facts and dimension derived from the synthetic star schema.

Mapping (FIXTURES.md section 2): nations play specialties, regions play
specialty groups (one region left out so some names stay unmatched);
line items are inpatient snapshot cells, orders are outpatient cells.
Nulls in codes and demographics are made on purpose so that the null rules
of the reports are exercised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.functions.constants import TIME_BANDS

UNMAPPED_REGION = "MIDDLE EAST"

# The columns in use, declared, so that no query opens files to learn their
# types before it runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dim_specialty(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    region = region.withColumnRenamed("r_regionkey", "n_regionkey")
    return (nation.join(region, "n_regionkey", "inner")
            .filter(F.col("r_name") != F.lit(UNMAPPED_REGION))
            .select(F.col("n_name").alias("specialty_name"),
                    F.col("r_name").alias("specialty_group")))


def _by_nation(spark: SparkSession, sf_dir: str, table: str, key: str, nation: str, as_key: str) -> DataFrame:
    """(as_key, specialty_name): the nation's name of each supplier or customer."""
    names = read_table(spark, sf_dir, "nation").selectExpr(f"n_nationkey AS {nation}", "n_name AS specialty_name")
    return (read_table(spark, sf_dir, table).join(names, nation, "inner")
            .selectExpr(f"{key} AS {as_key}", "specialty_name"))


def _band_at(index: str) -> str:
    return f"element_at(array({', '.join(repr(b) for b in TIME_BANDS)}), {index} + 1)"


# The columns are SQL texts: parsed in one go, where a call to the JVM per
# expression would take longer than planning the query.
def fact_inpatient(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read_table(spark, sf_dir, "lineitem").join(
        _by_nation(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "l_suppkey"), "l_suppkey", "inner")
    return joined.selectExpr(
        "CAST(l_shipdate AS DATE) AS archive_date",
        "CAST(CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_suppkey END AS INT) AS specialty_hipe",
        "specialty_name",
        "CASE l_linestatus WHEN 'F' THEN 'Day Case' WHEN 'O' THEN 'Inpatient' END AS case_type",
        "CASE WHEN l_returnflag = 'A' THEN 'Child' ELSE 'Adult' END AS adult_child",
        "CASE l_returnflag WHEN 'A' THEN '0-15' WHEN 'N' THEN '16-64' WHEN 'R' THEN '65+' END AS age_profile",
        _band_at("CAST(floor(round(l_discount * 100.0D) * 7.0D / 11.0D) AS INT)") + " AS time_bands",
        "CAST(floor(l_quantity) AS INT) AS total",
        "CAST(year(l_shipdate) AS INT) AS year")


def fact_outpatient(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read_table(spark, sf_dir, "orders").join(
        _by_nation(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "o_custkey"), "o_custkey", "inner")
    bands = " ".join(f"WHEN '{p}' THEN '{TIME_BANDS[i]}'" for p, i in zip("12345", (0, 1, 2, 3, 6)))
    return joined.selectExpr(
        "CAST(o_orderdate AS DATE) AS archive_date",
        "CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS INT) AS specialty_hipe",
        "specialty_name",
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'Child' ELSE 'Adult' END AS adult_child",
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN '0-15' "
        "WHEN o_orderstatus = 'O' THEN '16-64' WHEN o_orderstatus = 'F' THEN '65+' END AS age_profile",
        f"CASE substring(o_orderpriority, 1, 1) {bands} END AS time_bands",
        "CAST(floor(o_totalprice / 5000.0D) AS INT) AS total",
        "CAST(year(o_orderdate) AS INT) AS year")


@dataclass
class TestTables:
    inpatient: DataFrame
    outpatient: DataFrame
    dim: DataFrame


def load_tables(spark: SparkSession, sf_dir: str) -> TestTables:
    return TestTables(fact_inpatient(spark, sf_dir), fact_outpatient(spark, sf_dir),
                      dim_specialty(spark, sf_dir))
