"""Rank-based tests and correlations as aggregations.

Kruskal-Wallis and Mann-Whitney need only a handful of sums per group, taken
from value counts by ``rank_sums``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from queuelens.functions import tails as TL
from queuelens.operators.distribution import CNT

# An exact test wants no ties and a smaller sample of at most EXACT_SMALLER
# values; its counts take an array of up to half of n1 * n2 cells.
EXACT_SMALLER, EXACT_CELLS = 8, 1 << 18


def rank_sums(vc: DataFrame, group: str, value: str = "total", bucket_width: int = 4096,
              by: Sequence[str] = ()) -> DataFrame:
    """(by, group, n, rank_sum, ties): sizes, sums of mid-ranks and tie terms of value counts,
    ranked anew for each key in ``by``.

    A value's mid-rank is the count of smaller values plus (t + 1) / 2 for t
    ties. Smaller values of the same bucket of values are counted by a
    window per bucket; a whole bucket's shift, the size of all buckets before
    it, multiplies only the group's size there, so it is added to sums per
    (bucket, group). The counts are read once and no window holds more than
    a bucket of them. The tie term of a value, t^3 - t, is carried as
    cnt * (t^2 - 1) by its rows.
    """
    c = F.col(CNT).cast("double")
    bucket = F.floor(F.col(value) / F.lit(float(bucket_width))).alias("_b")
    at = vc.filter(F.col(value).isNotNull()).select(*by, group, value, CNT, bucket)
    ties = F.sum(CNT).over(W.partitionBy(*by, "_b", value)).cast("double")
    upto = F.sum(CNT).over(W.partitionBy(*by, "_b").orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow))
    inside = at.select("*", ties.alias("_t"), upto.cast("double").alias("_u"))
    per = inside.groupBy(*by, "_b", group).agg(
        F.sum(CNT).alias("n"), F.sum(c * (F.col("_u") - (F.col("_t") - 1.0) / 2.0)).alias("_r"),
        F.sum(c * (F.col("_t") * F.col("_t") - 1.0)).alias("ties"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("_b").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (per.withColumn("_before", before.cast("double")).groupBy(*by, group).agg(
        F.sum("n").alias("n"), F.sum(F.col("_r") + F.col("_before") * F.col("n")).alias("rank_sum"),
        F.sum("ties").alias("ties")))


def kruskal_wallis(vc: DataFrame, group: str, value: str = "total") -> DataFrame:
    """One row: h, dof, n, groups (tie-corrected H)."""
    s = rank_sums(vc, group, value).agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_srn"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("ties").alias("_tt"))
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_srn") - F.lit(3.0) * (n + 1)
    corr = F.lit(1.0) - F.col("_tt") / (n * n * n - n)
    return s.select(F.try_divide(h, corr).alias("h"), (F.col("groups") - 1).alias("dof"),
                    F.col("n"), F.col("groups"))


def mann_whitney(vc: DataFrame, group: str, first, value: str = "total", by: Sequence[str] = ()) -> DataFrame:
    """A row per key in ``by`` (one row without): u (for the ``first`` sample), n1, n2, z and ties.

    z is continuity and tie corrected, on max(U1, U2) as in the two-sided
    asymptotic test; 0 where U is within the correction of its mean. ties is
    the sum of t^3 - t, 0 where all values differ.
    """
    is1 = F.col(group) == F.lit(first)
    s = rank_sums(vc, group, value, by=by).groupBy(*by).agg(
        F.sum(F.when(is1, F.col("rank_sum"))).alias("_r1"), F.sum(F.when(is1, F.col("n"))).alias("n1"),
        F.sum(F.when(~is1, F.col("n"))).alias("n2"), F.sum("ties").alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    mu = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u - mu - F.lit(0.5), F.lit(0.0)), sd)
    return s.select(*by, u1.alias("u"), F.col("n1"), F.col("n2"), z.alias("z"), F.col("ties"))


def orders_up_to(small: Column, large: Column, most: Column) -> Column:
    """Number of orders of two samples without ties whose U is at most ``most``, as a decimal.

    The number of orders for each U are the coefficients of the product over
    i = 1 .. small of (1 - q^(large + i)) / (1 - q^i), counted up to q^most:
    the numerator is one shifted difference, the denominator the product of
    (1 + q^(i 2^j)), a shifted sum for each j.
    """
    whole, none = "decimal(38,0)", F.lit(0).cast("decimal(38,0)")

    def shifted(ways: Column, at: Column) -> Column:
        return F.coalesce(F.get(ways, at.cast("int")), none)

    def divided(ways: Column, i: Column) -> Column:
        doublings = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.try_divide(most, i))).cast("int")))
        return F.aggregate(doublings, ways, lambda w, j: F.transform(
            w, lambda x, k: (x + shifted(w, k - i * F.pow(F.lit(2.0), j))).cast(whole)))

    def factor(ways: Column, i: Column) -> Column:
        return divided(F.transform(ways, lambda x, k: (x - shifted(ways, k - (large + i))).cast(whole)), i)

    one = F.transform(F.sequence(F.lit(0), most.cast("int")), lambda k: F.when(k == 0, F.lit(1)).otherwise(F.lit(0)).cast(whole))
    ways = F.aggregate(F.sequence(F.lit(1), small.cast("int")), one, factor)
    return F.aggregate(ways, none, lambda a, x: (a + x).cast(whole))


def with_mann_whitney_p(df: DataFrame, out: str = "p_value", exact: str = "exact") -> DataFrame:
    """Rows of ``mann_whitney`` with the two-sided p-value and whether it is exact.

    Exact, by counting all orders of the samples, where no values tie, the
    smaller sample has at most 8 values and n1 * n2 is at most 2^18; else the
    normal approximation. Null where a sample is empty.
    """
    staged = df.withColumn("_small", F.least("n1", "n2")).withColumn("_large", F.greatest("n1", "n2")).withColumn(
        "_most", F.least(F.col("u"), F.col("n1") * F.col("n2") - F.col("u")))
    small, large = F.col("_small"), F.col("_large")
    fits = ((F.col("ties") == 0) & F.col("n1").isNotNull() & F.col("n2").isNotNull() & (small >= 1)
            & (small <= EXACT_SMALLER) & (small * large <= EXACT_CELLS))
    staged = staged.withColumn(exact, F.coalesce(fits, F.lit(False)))
    orders = F.aggregate(F.sequence(F.lit(1), small.cast("int")), F.lit(1.0), lambda a, i: a * (large + i) / i)
    below = orders_up_to(small, large, F.col("_most"))
    staged = TL.with_normal_two_sided(staged, "z", "_p_normal")
    counted = F.least(F.lit(1.0), 2.0 * below.cast("double") / orders)
    return staged.withColumn(out, F.when(F.col(exact), counted).otherwise(F.col("_p_normal"))).drop(
        "_small", "_large", "_most", "_p_normal")


def midrank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Average rank of ``c`` over the whole (small, aggregated) frame."""
    w = W.orderBy(c)
    ties = F.count(F.lit(1)).over(W.partitionBy(c))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n, on an already aggregated frame (ranks over all rows)."""
    ranked = midrank(midrank(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
            .agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"),
                 F.count(F.lit(1)).alias("n")))
