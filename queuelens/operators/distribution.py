"""Exact distribution statistics over value-count tables.

``total`` is an integer count with few distinct values compared to rows, so
every record-level statistic first reduces the data to (keys, value, count)
with a partially aggregated groupBy. Percentiles, moments, modes, outlier
counts, histograms, box statistics and kernel densities are then computed
on that small table. Nothing ranks or sorts raw rows, and a hot key only
adds to one counter per map task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from queuelens.functions import measures as M

CNT = "cnt"


def value_counts(df: DataFrame, keys: list[str], value: str = "total") -> DataFrame:
    """(keys..., value, cnt): the distribution of ``value`` per key.

    Rows with a null key or value carry no rank or quantile and are left out
    up front; stating it here also keeps the later joins from adding their
    own inferred not-null filters below this aggregate, so every consumer of
    the table shares one identical subtree (and Spark reuses its exchange
    instead of reading the facts again).
    """
    cond = F.col(value).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(CNT))


def percentiles(vc: DataFrame, keys: list[str], value: str, probs: list[float],
                prefix: str = "p") -> DataFrame:
    """Exact linear-interpolation percentiles from a value-count table."""
    agg = vc.groupBy(*keys).agg(
        F.percentile(F.col(value), [float(p) for p in probs], F.col(CNT)).alias("_q"))
    return agg.select(*keys, *[F.col("_q")[i].alias(f"{prefix}{i}") for i in range(len(probs))])


def describe(vc: DataFrame, keys: list[str], value: str = "total") -> DataFrame:
    """The full descriptive row (count, sum, moments, quantiles, mode, outliers).

    ``keys`` must be non-empty (use a literal label column for a single set).
    Per-key mean and quantiles are windows over the value-count table, the
    rest one aggregation: the table has a single consumer.
    """
    if not keys:
        raise ValueError("describe needs at least one key column")
    part = W.partitionBy(*keys)
    x, c = F.col(value).cast("double"), F.col(CNT)
    mean = (F.sum(F.col(value).cast("long") * c).over(part).cast("double")
            / F.sum(c).over(part).cast("double"))
    w = vc.select(*keys, value, CNT, mean.alias("mean"),
                  F.percentile(F.col(value), [0.5, 0.25, 0.75, 0.05, 0.95, 0.99], c).over(part).alias("_q"))
    d = x - F.col("mean")
    q1, q3 = F.col("_q")[1], F.col("_q")[2]
    iqr = q3 - q1
    outlier = (x < q1 - F.lit(1.5) * iqr) | (x > q3 + F.lit(1.5) * iqr)
    out = w.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(F.col(value).cast("long") * c).alias("sum"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.max_by(F.col(value), F.struct(c, -F.col(value))).alias("mode"),
        F.first("mean").alias("mean"), F.first("_q").alias("_q"),
        F.sum(c * d * d).alias("_m2"), F.sum(c * d * d * d).alias("_m3"),
        F.sum(c * d * d * d * d).alias("_m4"),
        F.sum(F.when(outlier, c).otherwise(F.lit(0))).alias("outliers"))
    n = F.col("n").cast("double")
    var = F.try_divide(F.col("_m2"), n - 1)
    m2, m3, m4 = F.col("_m2") / n, F.col("_m3") / n, F.col("_m4") / n
    skew = F.when((n > 2) & (m2 > 0),
                  F.sqrt(n * (n - 1)) / (n - 2) * m3 / F.pow(m2, 1.5))
    kurt = F.when((n > 3) & (m2 > 0),
                  (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6))
    q1, q3 = F.col("_q")[1], F.col("_q")[2]
    return out.select(
        *keys, F.col("n"), F.col("sum"), F.col("mean"), F.col("_q")[0].alias("median"),
        F.col("mode"), F.sqrt(var).alias("std"), var.alias("var"),
        F.col("min"), F.col("max"), (F.col("max") - F.col("min")).alias("range"),
        q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        F.col("_q")[3].alias("p5"), F.col("_q")[4].alias("p95"), F.col("_q")[5].alias("p99"),
        M.pct(F.sqrt(var), "mean").alias("cv_pct"),
        skew.alias("skewness"), kurt.alias("kurtosis"), F.col("outliers"))


def histogram(vc: DataFrame, keys: list[str], value: str, bins: int, upper_q: float,
              carry: dict | None = None) -> DataFrame:
    """Histogram of ``least(value, p_upper)`` with ``bins`` equal bins from min to
    the clip point (last bin closed), all bins present, zero-filled.

    Clip point and range are windows over the value-count table; counts per
    bin are one aggregation; the bin axis is a fixed ``sequence`` per key.
    ``carry`` maps names to functions of the per-key window spec returning a
    column (e.g. ``lambda w: F.avg("x").over(w)``); each is added to every
    output row.
    """
    part = W.partitionBy(*keys)
    carry = carry or {}
    extra = list(carry)
    clip_at = F.percentile(F.col(value), F.lit(float(upper_q)), F.col(CNT)).over(part)
    lo0 = F.least(F.min(value).over(part).cast("double"), F.col("clip_at"))
    w = vc.select(*keys, value, CNT, clip_at.alias("clip_at"),
                  *[fn(part).alias(n) for n, fn in carry.items()])
    w = w.select("*", lo0.alias("_lo"))
    same = F.col("_lo") == F.col("clip_at")       # numpy widens an empty range by 0.5
    w = w.select("*", F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
                 F.when(same, F.col("clip_at") + 0.5).otherwise(F.col("clip_at")).alias("hi"))
    clipped = F.least(F.col(value).cast("double"), F.col("clip_at"))
    idx = F.floor((clipped - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo"))))
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1)).cast("int")
    per_bin = w.groupBy(*keys, "lo", "hi", *extra, idx.alias("bin")).agg(F.sum(CNT).alias("frequency"))
    per_key = per_bin.groupBy(*keys, "lo", "hi", *extra).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "frequency"))).alias("_m"))
    grid = per_key.select(*keys, "lo", "hi", *extra, "_m",
                          F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.select(*keys, "bin", *extra,
                       M.round_half(F.col("lo") + F.col("bin") * step, 6).alias("bin_start"),
                       M.round_half(F.col("lo") + (F.col("bin") + 1) * step, 6).alias("bin_end"),
                       F.coalesce(F.col("_m")[F.col("bin")], F.lit(0)).cast("long").alias("frequency"))


def box_stats(vc: DataFrame, keys: list[str], value: str = "x", whis: float = 1.5) -> DataFrame:
    """Notched box-plot statistics (quartiles, whiskers within whis*IQR, notch,
    flier count) from a value-count table.

    All per-key quantities are windows partitioned by the keys over the
    value-count table (one exchange, one consumer), then one aggregation.
    """
    part = W.partitionBy(*keys)
    x, c = F.col(value), F.col(CNT)
    q = vc.select(*keys, value, CNT, F.sum(CNT).over(part).alias("n"),
                  F.percentile(x, [0.25, 0.5, 0.75], c).over(part).alias("_q"))
    q = q.select("*", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_lim = F.col("q1") - F.lit(whis) * F.col("iqr")
    hi_lim = F.col("q3") + F.lit(whis) * F.col("iqr")
    w = q.select("*", F.min(F.when(x >= lo_lim, x)).over(part).alias("whisker_low"),
                 F.max(F.when(x <= hi_lim, x)).over(part).alias("whisker_high"))
    flier = (x < F.col("whisker_low")) | (x > F.col("whisker_high"))
    out = w.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.first("iqr").alias("iqr"),
        F.first("whisker_low").alias("whisker_low"), F.first("whisker_high").alias("whisker_high"),
        F.sum(F.when(flier, c).otherwise(F.lit(0))).alias("fliers"))
    notch = F.lit(1.57) * F.col("iqr") / F.sqrt(F.col("n").cast("double"))
    return out.select(*keys, "n", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high",
                      (F.col("median") - notch).alias("notch_low"),
                      (F.col("median") + notch).alias("notch_high"), "fliers")


def gaussian_kde(vc: DataFrame, keys: list[str], value: str = "x", points: int = 100,
                 cells: int = 16384) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced coordinates between
    each key's min and max, Scott bandwidth (n^-1/5 times the sample std).

    Each key's values go to ``cells`` equal cells of its range, of which the
    weight, the mean and the spread are kept; a cell adds its kernel at the
    mean and the kernel's second derivative times half the spread. So the work
    after the value counts is cells x points per key, however many distinct
    values there are, and windows hold a key's cells, not its values. A cell
    with one distinct value is exact; otherwise the third-order rest is at
    most 0.0115 h^3 / bw^4 for cells of width h, given as ``error_bound``.
    Density and bound are null where the bandwidth is zero or undefined (one
    row, or equal values). An empty table gives no rows.
    """
    if points < 2 or cells < 1:
        raise ValueError("two points and one cell are the least")
    ends = vc.groupBy(*keys).agg(F.min(value).cast("double").alias("vmin"), F.max(value).cast("double").alias("vmax"))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "vmin", "vmax")
    on = reduce(Column.__and__, (F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)))
    x, c = F.col(value).cast("double"), F.col(CNT).cast("double")
    width = (F.col("vmax") - F.col("vmin")) / F.lit(float(cells))
    cell = F.least(F.floor(F.coalesce(F.try_divide(x - F.col("vmin"), width), F.lit(0.0))), F.lit(cells - 1))
    d = x - (F.col("vmin") + (F.col("_cell") + 0.5) * width)
    per_cell = (vc.join(ends, on).withColumn("_cell", cell).groupBy(*keys, "vmin", "vmax", "_cell")
                .agg(F.sum(c).alias("_w"), F.sum(c * d).alias("_s1"), F.sum(c * d * d).alias("_s2")))
    shift = F.col("_s1") / F.col("_w")
    per_cell = per_cell.select(
        *keys, "vmin", "vmax", width.alias("_h"), "_w",
        (F.col("vmin") + (F.col("_cell") + 0.5) * width + shift).alias("_at"),
        F.greatest(F.col("_s2") - F.col("_s1") * shift, F.lit(0.0)).alias("_m2"))
    part = W.partitionBy(*keys)
    n = F.col("n")
    off = F.col("_at") - F.col("_mean")
    w = per_cell.select("*", F.sum("_w").over(part).alias("n"))
    w = w.select("*", (F.sum(F.col("_w") * F.col("_at")).over(part) / n).alias("_mean"))
    ss = F.sum(F.col("_m2") + F.col("_w") * off * off).over(part)
    bw = F.sqrt(F.try_divide(ss, n - 1)) * F.pow(n, F.lit(-0.2))
    w = w.select("*", F.when(F.col("vmax") > F.col("vmin"), bw).alias("bw"))
    v = w.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    coord = F.col("vmin") + F.col("point") * ((F.col("vmax") - F.col("vmin")) / F.lit(float(points - 1)))
    z = (coord - F.col("_at")) / F.col("bw")
    contrib = F.exp(F.lit(-0.5) * z * z) * (
        F.col("_w") + F.lit(0.5) * (z * z - 1) * F.col("_m2") / (F.col("bw") * F.col("bw")))
    dens = v.groupBy(*keys, "point", "n", "vmin", "vmax", "_h", "bw").agg(F.sum(contrib).alias("_k"))
    norm = n * F.col("bw") * F.lit(math.sqrt(2.0 * math.pi))
    return dens.select(*keys, "point", coord.alias("coord"), (F.col("_k") / norm).alias("density"),
                       (F.lit(0.0115) * F.pow("_h", F.lit(3.0)) / F.pow("bw", F.lit(4.0))).alias("error_bound"),
                       "vmin", "vmax")
