"""Contingency tables and the chi-square test of independence.

Cells are record counts per (row, column) pair, kept long. The table is
densified over the categories seen in each margin: every row category is
expanded over the set of column categories (collected by a window over the
small aggregated cell table, so no extra pass over the data and no
cartesian join), then left-joined to the counts. Expected counts come from
window sums over the same small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def densify_cells(cells: DataFrame, row: str, column: str, value: str = "observed") -> DataFrame:
    """Every row category x every column category of a small cell table, 0-filled.

    Windows only (the cell table has one consumer): the set of column
    categories over the whole table and a column->count map per row
    category; each row category is then expanded over the set.
    """
    cols = F.collect_set(column).over(W.partitionBy())
    per_row = F.map_from_entries(F.collect_list(F.struct(column, value)).over(W.partitionBy(row)))
    wide = cells.select(row, cols.alias("_cols"), per_row.alias("_m")).dropDuplicates([row])
    long = wide.select(row, "_m", F.explode("_cols").alias(column))
    return long.select(row, column, F.coalesce(F.col("_m")[F.col(column)], F.lit(0)).cast("long").alias(value))


def crosstab_long(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, observed) for every row x column category pair, zeros kept;
    rows with a null in either key are left out (as a crosstab does)."""
    clean = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = clean.groupBy(row, column).agg(F.count(F.lit(1)).alias("observed"))
    return densify_cells(cells, row, column)


def expected(ct: DataFrame, row: str, column: str) -> DataFrame:
    """Adds row/column margins, N, expected count and standardised residual."""
    all_ = W.partitionBy()
    o = F.col("observed").cast("double")
    out = ct.select(row, column, "observed",
                    F.sum(o).over(W.partitionBy(row)).alias("_rs"),
                    F.sum(o).over(W.partitionBy(column)).alias("_cs"),
                    F.sum(o).over(all_).alias("_n"),
                    F.size(F.collect_set(row).over(all_)).alias("_r"),
                    F.size(F.collect_set(column).over(all_)).alias("_c"))
    e = F.col("_rs") * F.col("_cs") / F.col("_n")
    return out.withColumn("expected", e).withColumn(
        "std_residual", F.try_divide(o - F.col("expected"), F.sqrt(F.col("expected"))))


def chi_square(ct: DataFrame, row: str, column: str) -> DataFrame:
    """One row: chi2, dof, n, cramers_v. Yates' correction when dof == 1."""
    ex = expected(ct, row, column)
    dof = (F.col("_r") - 1) * (F.col("_c") - 1)
    o = F.col("observed").cast("double")
    diff = F.col("expected") - o
    adj = o + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)
    obs = F.when(dof == 1, adj).otherwise(o)
    term = F.try_divide((obs - F.col("expected")) * (obs - F.col("expected")), F.col("expected"))
    s = ex.groupBy().agg(F.sum(term).alias("chi2"), F.first(dof).alias("dof"),
                         F.first("_n").alias("_n"), F.first("_r").alias("_r"),
                         F.first("_c").alias("_c"))
    k = F.least(F.col("_r"), F.col("_c")) - 1
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("_n") * k))
    return s.select("chi2", F.col("dof").cast("long").alias("dof"),
                    F.col("_n").cast("long").alias("n"), v.alias("cramers_v"))
