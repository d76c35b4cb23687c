"""The canonical waiting-list model.

``waiting_list_full`` is the union of both facts tagged with the patient
type, left-joined to the specialty dimension (the planner picks the join from
the dimension's size), with the group defaulted to 'Other' and the calendar keys and band
ordinals derived once. Reports take this DataFrame; column pruning and
predicate pushdown carry their needs down to the fact scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions import measures as M
from queuelens.functions.constants import PATIENT_TYPES

VIEW_COLUMNS = ["archive_date", "specialty_name", "adult_child", "age_profile",
                "time_bands", "total", "year"]


def waiting_list(inpatient: DataFrame, outpatient: DataFrame) -> DataFrame:
    """UNION ALL of the facts with a literal patient type (plus case type and code)."""
    ip = inpatient.selectExpr(*VIEW_COLUMNS, f"'{PATIENT_TYPES[0]}' AS patient_type", "case_type", "specialty_hipe")
    op = outpatient.selectExpr(*VIEW_COLUMNS, f"'{PATIENT_TYPES[1]}' AS patient_type",
                               "CAST(NULL AS STRING) AS case_type", "specialty_hipe")
    return ip.unionByName(op)


def enrich(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join to the dimension, default group, calendar keys and band ordinals."""
    joined = df.join(dim.select("specialty_name", "specialty_group"), "specialty_name", "left")
    return joined.select(
        "*",
        F.date_format("archive_date", "yyyy-MM").alias("year_month"),
        F.month("archive_date").alias("month"),
        M.wait_rank().alias("wait_rank"),
        M.band_rank().alias("band_rank"),
    ).withColumn("specialty_group", M.default_group())


def drop_null_age(df: DataFrame) -> DataFrame:
    """The pandas pipeline drops outpatient rows without an age profile."""
    return df.filter((F.col("patient_type") == PATIENT_TYPES[0]) | F.col("age_profile").isNotNull())


@dataclass
class WaitingList:
    """Facts and dimension, with lazily built canonical views."""
    inpatient: DataFrame
    outpatient: DataFrame
    dim: DataFrame
    _full: DataFrame | None = field(default=None, repr=False)

    def full(self) -> DataFrame:
        """vw_waiting_list_full (SQL views keep rows with null ages)."""
        if self._full is None:
            self._full = enrich(waiting_list(self.inpatient, self.outpatient), self.dim)
        return self._full

    def combined(self) -> DataFrame:
        """The pandas pipeline's ``combined`` frame (null outpatient ages dropped)."""
        return drop_null_age(self.full())

    def view(self, drop_null_ages: bool) -> DataFrame:
        return self.combined() if drop_null_ages else self.full()

    def ip(self) -> DataFrame:
        """Inpatient rows of the enriched model."""
        return self.combined().filter(F.col("patient_type") == PATIENT_TYPES[0])

    def op(self) -> DataFrame:
        """Outpatient rows after the null-age drop."""
        return self.combined().filter(F.col("patient_type") == PATIENT_TYPES[1])


def register_views(wl: WaitingList, prefix: str = "") -> list[str]:
    """Expose the star schema to Spark SQL as temporary views:
    dim_specialty, fact_inpatient, fact_outpatient, vw_waiting_list and
    vw_waiting_list_full (plus ``combined`` with the pandas null-age rule)."""
    views = {
        "dim_specialty": wl.dim,
        "fact_inpatient": wl.inpatient,
        "fact_outpatient": wl.outpatient,
        "vw_waiting_list": waiting_list(wl.inpatient, wl.outpatient),
        "vw_waiting_list_full": wl.full(),
        "combined": wl.combined(),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in views]
