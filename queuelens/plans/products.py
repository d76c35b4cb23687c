"""Chart panels and summary tables of the pandas analysis, as DataFrame plans.

They read the pipeline's ``combined`` frame (null outpatient ages dropped)
and, like pandas group-bys, leave out null group keys. Pivots use explicit
category lists, densified axes come from the data (distinct keys exploded
over the fixed band list), and record-level statistics go through the
value-count operators in ``operators.distribution``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from queuelens.functions import measures as M
from queuelens.functions.constants import (ADULT_CHILD, PATIENT_TYPES,
                                           TIME_BANDS)
from queuelens.functions.options import Options
from queuelens.operators import distribution as D
from queuelens.operators.contingency import crosstab_long, expected
from queuelens.operators.model import WaitingList
from queuelens.operators.quantiles import wide_percentiles
from queuelens.plans import sqlkit as S

SQL: dict[str, str] = {}
IP, OP = PATIENT_TYPES
_TYPE_COLS = {IP: "inpatient", OP: "outpatient"}


def _pivot_types(df: DataFrame, key: str, fill_zero: bool) -> DataFrame:
    wide = df.groupBy(key).pivot("patient_type", list(PATIENT_TYPES)).agg(F.sum("total"))
    wide = wide.withColumnsRenamed(_TYPE_COLS)
    return wide.na.fill(0, list(_TYPE_COLS.values())) if fill_zero else wide


def _sql_type_cols(fill_zero: bool, cond: str = "TRUE") -> str:
    out = []
    for t, name in _TYPE_COLS.items():
        e = f"SUM(CASE WHEN patient_type = '{t}' AND {cond} THEN total END)"
        out.append(f"CAST({'COALESCE(' + e + ', 0)' if fill_zero else e} AS BIGINT) AS {name}")
    return ", ".join(out)


def _band_totals(df: DataFrame, key: str) -> DataFrame:
    """(key, time_bands, band_order, total_patients) for all 7 bands of every key
    present, 0-filled: one aggregation with a sum per band, then a fixed
    7-way unpivot (no join back, no cartesian product)."""
    sums = [M.sum_when(F.col("time_bands") == F.lit(b)).alias(f"_b{i}") for i, b in enumerate(TIME_BANDS, 1)]
    wide = df.groupBy(key).agg(*sums)
    rows = F.array(*[F.struct(F.lit(b).alias("time_bands"), F.lit(i).alias("band_order"),
                              F.col(f"_b{i}").cast("long").alias("total_patients"))
                     for i, b in enumerate(TIME_BANDS, 1)])
    return wide.select(key, F.inline(rows))


_BAND_VALUES = ", ".join(f"('{b}', {i})" for i, b in enumerate(TIME_BANDS, start=1))


# K1 -------------------------------------------------------------------------
def annual_pivot(wl: WaitingList, o: Options = Options()) -> DataFrame:
    return _pivot_types(wl.combined(), "year", fill_zero=False).orderBy("year")


SQL["annual_pivot"] = S.with_adapter(f"""
SELECT year, {_sql_type_cols(False)} FROM combined GROUP BY year""")


# K2 -------------------------------------------------------------------------
def yoy_pct_change(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Change on the previous year present for the type (pandas pct_change)."""
    t = wl.combined().groupBy("patient_type", "year").agg(F.sum("total").alias("total_patients"))
    prev = F.lag("total_patients").over(W.partitionBy("patient_type").orderBy("year"))
    return (t.withColumn("prior_total", prev).filter(F.col("prior_total").isNotNull())
            .withColumn("pct_change", M.round_half(
                M.pct(F.col("total_patients") - F.col("prior_total"), "prior_total"), 1))
            .orderBy("patient_type", "year"))


SQL["yoy_pct_change"] = S.with_adapter(f"""
SELECT * FROM (
  SELECT patient_type, year, total_patients,
         LAG(total_patients) OVER (PARTITION BY patient_type ORDER BY year) AS prior_total,
         {S.rnd(S.pct('total_patients - LAG(total_patients) OVER (PARTITION BY patient_type ORDER BY year)', 'LAG(total_patients) OVER (PARTITION BY patient_type ORDER BY year)'), 1)} AS pct_change
  FROM t) WHERE prior_total IS NOT NULL""", ctes="""
t AS (SELECT patient_type, year, CAST(SUM(total) AS BIGINT) AS total_patients
      FROM combined GROUP BY patient_type, year)""")


# K3 -------------------------------------------------------------------------
def monthly_pivot(wl: WaitingList, o: Options = Options()) -> DataFrame:
    m = _pivot_types(wl.combined(), "year_month", fill_zero=True)
    return (m.withColumn("month_index", F.row_number().over(W.orderBy("year_month")) - 1)
            .withColumn("is_marker", F.col("year_month") == F.lit(o.marker_month))
            .orderBy("year_month"))


SQL["monthly_pivot"] = S.with_adapter(f"""
SELECT year_month, {_sql_type_cols(True)},
       CAST(ROW_NUMBER() OVER (ORDER BY year_month) - 1 AS INTEGER) AS month_index,
       year_month = '2000-03' AS is_marker
FROM combined GROUP BY year_month""")


# K4 -------------------------------------------------------------------------
def histogram_by_type(wl: WaitingList, o: Options = Options()) -> DataFrame:
    vc = D.value_counts(wl.combined(), ["patient_type"], "total")
    carry = {"_mean": lambda w: F.sum(F.col("total") * F.col(D.CNT)).over(w) / F.sum(D.CNT).over(w),
             "_median": lambda w: F.percentile("total", F.lit(0.5), F.col(D.CNT)).over(w)}
    h = D.histogram(vc, ["patient_type"], "total", o.hist_bins, o.winsor_quantile, carry)
    return (h.select("patient_type", "bin", "bin_start", "bin_end", "frequency",
                     M.round_half("_mean", 4).alias("mean_total"), M.round_half("_median", 4).alias("median_total"))
            .orderBy("patient_type", "bin"))


SQL["histogram_by_type"] = S.with_adapter(f"""
SELECT g.patient_type, g.bin,
       {S.rnd('g.lo + g.bin * ((g.hi - g.lo) / 50.0)', 6)} AS bin_start,
       {S.rnd('g.lo + (g.bin + 1) * ((g.hi - g.lo) / 50.0)', 6)} AS bin_end,
       CAST(COALESCE(b.frequency, 0) AS BIGINT) AS frequency,
       {S.rnd('g.mean_total', 4)} AS mean_total, {S.rnd('g.median_total', 4)} AS median_total
FROM g LEFT JOIN b ON g.patient_type = b.patient_type AND g.bin = b.bin""", ctes=f"""
p AS (SELECT patient_type, quantile_cont(total, 0.98) AS clip_at, least(MIN(total), quantile_cont(total, 0.98)) AS mn,
             AVG(total) AS mean_total, quantile_cont(total, 0.5) AS median_total
      FROM combined GROUP BY patient_type),
r AS (SELECT patient_type, clip_at, mean_total, median_total,
             CASE WHEN mn = clip_at THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = clip_at THEN clip_at + 0.5 ELSE clip_at END AS hi FROM p),
b AS (SELECT c.patient_type,
             CAST(least(greatest(floor((least(CAST(c.total AS DOUBLE), r.clip_at) - r.lo) * (50.0 / (r.hi - r.lo))), 0), 49) AS INTEGER) AS bin,
             COUNT(*) AS frequency
      FROM combined c JOIN r ON c.patient_type = r.patient_type GROUP BY 1, 2),
g AS (SELECT r.*, CAST(t.i AS INTEGER) AS bin FROM r CROSS JOIN range(50) t(i))""")


# K5 -------------------------------------------------------------------------
def _log_counts(wl: WaitingList) -> DataFrame:
    c = wl.combined()
    return c.groupBy("year", F.log(F.lit(1.0) + F.col("total")).alias("x")).agg(
        F.count(F.lit(1)).alias(D.CNT))


def box_by_year(wl: WaitingList, o: Options = Options()) -> DataFrame:
    b = D.box_stats(_log_counts(wl), ["year"], "x")
    dbl = ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "notch_low", "notch_high"]
    return b.select("year", "n", *[M.round_half(c, 6).alias(c) for c in dbl], "fliers").orderBy("year")


SQL["box_by_year"] = S.with_adapter(f"""
SELECT q.year, q.n, {S.rnd('q.q1', 6)} AS q1, {S.rnd('q.med', 6)} AS median, {S.rnd('q.q3', 6)} AS q3,
       {S.rnd('q.q3 - q.q1', 6)} AS iqr, {S.rnd('w.wl', 6)} AS whisker_low, {S.rnd('w.wh', 6)} AS whisker_high,
       {S.rnd('q.med - 1.57 * (q.q3 - q.q1) / sqrt(q.n)', 6)} AS notch_low,
       {S.rnd('q.med + 1.57 * (q.q3 - q.q1) / sqrt(q.n)', 6)} AS notch_high,
       f.fliers
FROM q JOIN w ON q.year = w.year JOIN f ON q.year = f.year""", ctes="""
x AS (SELECT year, ln(1 + total) AS x FROM combined),
q AS (SELECT year, COUNT(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
             quantile_cont(x, 0.75) AS q3 FROM x GROUP BY year),
w AS (SELECT x.year, MIN(CASE WHEN x.x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x.x END) AS wl,
             MAX(CASE WHEN x.x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x.x END) AS wh
      FROM x JOIN q ON x.year = q.year GROUP BY x.year),
f AS (SELECT x.year, COUNT(*) FILTER (WHERE x.x < w.wl OR x.x > w.wh) AS fliers
      FROM x JOIN w ON x.year = w.year GROUP BY x.year)""")


# K6 -------------------------------------------------------------------------
def descriptive_table(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Inpatient, Outpatient and Combined rows; the combined distribution is the
    sum of the per-type value counts (no second scan)."""
    vt = D.value_counts(wl.combined(), ["patient_type"], "total")
    per_type = vt.select(F.col("patient_type").alias("dataset"), "total", D.CNT)
    allrows = vt.groupBy("total").agg(F.sum(D.CNT).alias(D.CNT)) \
                .select(F.lit("Combined").alias("dataset"), "total", D.CNT)
    d = D.describe(per_type.unionByName(allrows), ["dataset"], "total")
    r = M.round_half
    return d.select(
        "dataset", "n", F.col("sum").alias("sum_total"), r("mean", 3).alias("mean"),
        r("median", 3).alias("median"), F.col("mode"), r("std", 3).alias("std_dev"),
        r("var", 3).alias("variance"), F.col("min").alias("min_val"), F.col("max").alias("max_val"),
        F.col("range").alias("range_val"), r("q1", 3).alias("q1"), r("q3", 3).alias("q3"),
        r("iqr", 3).alias("iqr"), r("p5", 3).alias("p5"), r("p95", 3).alias("p95"),
        r("p99", 3).alias("p99"), r("cv_pct", 2).alias("cv_pct"),
        r("skewness", 4).alias("skewness"), r("kurtosis", 4).alias("kurtosis"),
        F.col("outliers")).orderBy("dataset")


SQL["descriptive_table"] = S.with_adapter(f"""
SELECT s.dataset, s.n, s.sum_total, {S.rnd('s.mean', 3)} AS mean, {S.rnd('s.median', 3)} AS median,
       mo.mode, {S.rnd('s.sd', 3)} AS std_dev, {S.rnd('s.var', 3)} AS variance,
       s.min_val, s.max_val, s.max_val - s.min_val AS range_val,
       {S.rnd('s.q1', 3)} AS q1, {S.rnd('s.q3', 3)} AS q3, {S.rnd('s.q3 - s.q1', 3)} AS iqr,
       {S.rnd('s.p5', 3)} AS p5, {S.rnd('s.p95', 3)} AS p95, {S.rnd('s.p99', 3)} AS p99,
       {S.rnd('s.sd / s.mean * 100.0', 2)} AS cv_pct,
       {S.rnd('s.skew', 4)} AS skewness, {S.rnd('s.kurt', 4)} AS kurtosis, ol.outliers
FROM s JOIN mo ON s.dataset = mo.dataset JOIN ol ON s.dataset = ol.dataset""", ctes="""
d AS (SELECT patient_type AS dataset, total FROM combined
      UNION ALL SELECT 'Combined' AS dataset, total FROM combined),
s AS (SELECT dataset, COUNT(*) AS n, CAST(SUM(total) AS BIGINT) AS sum_total, AVG(total) AS mean,
             quantile_cont(total, 0.5) AS median, stddev_samp(total) AS sd, var_samp(total) AS var,
             MIN(total) AS min_val, MAX(total) AS max_val,
             quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3,
             quantile_cont(total, 0.05) AS p5, quantile_cont(total, 0.95) AS p95,
             quantile_cont(total, 0.99) AS p99, skewness(total) AS skew, kurtosis(total) AS kurt
      FROM d GROUP BY dataset),
vc AS (SELECT dataset, total, COUNT(*) AS c FROM d GROUP BY dataset, total),
mo AS (SELECT dataset, MIN(total) AS mode FROM
         (SELECT dataset, total, c, MAX(c) OVER (PARTITION BY dataset) AS mc FROM vc)
       WHERE c = mc GROUP BY dataset),
ol AS (SELECT d.dataset, COUNT(*) FILTER (WHERE d.total < s.q1 - 1.5 * (s.q3 - s.q1)
                                           OR d.total > s.q3 + 1.5 * (s.q3 - s.q1)) AS outliers
       FROM d JOIN s ON d.dataset = s.dataset GROUP BY d.dataset)""")


# K7 -------------------------------------------------------------------------
def band_pct_by_type(wl: WaitingList, o: Options = Options()) -> DataFrame:
    dense = _band_totals(wl.combined(), "patient_type")
    return (dense.select("patient_type", "time_bands", "band_order", "total_patients",
                         M.round_half(M.pct("total_patients", F.sum("total_patients")
                                            .over(W.partitionBy("patient_type"))), 2).alias("pct_of_type"))
            .orderBy("patient_type", "band_order"))


SQL["band_pct_by_type"] = S.with_adapter(f"""
SELECT patient_type, time_bands, band_order, total_patients,
       {S.rnd(S.pct('total_patients', 'SUM(total_patients) OVER (PARTITION BY patient_type)'), 2)} AS pct_of_type
FROM (SELECT t.patient_type, b.time_bands, b.band_order,
             CAST(COALESCE(a.s, 0) AS BIGINT) AS total_patients
      FROM (SELECT DISTINCT patient_type FROM combined) t
      CROSS JOIN (VALUES {_BAND_VALUES}) b(time_bands, band_order)
      LEFT JOIN (SELECT patient_type, time_bands, SUM(total) AS s FROM combined GROUP BY 1, 2) a
        ON a.patient_type = t.patient_type AND a.time_bands = b.time_bands)""")


# K8 -------------------------------------------------------------------------
def _specialty_totals(c: DataFrame) -> DataFrame:
    return c.groupBy("patient_type", "specialty_name").agg(F.sum("total").alias("total_patients"))


def _top_per_type(c: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("patient_type").orderBy(F.desc("total_patients"), "specialty_name")
    return (_specialty_totals(c).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def top_specialties(wl: WaitingList, o: Options = Options()) -> DataFrame:
    return (_top_per_type(wl.combined(), o.top_per_type)
            .select("patient_type", "rank", "specialty_name", "total_patients")
            .orderBy("patient_type", "rank"))


def _top_sql(k: int) -> str:
    return f"""(SELECT * FROM (SELECT patient_type, specialty_name, CAST(SUM(total) AS BIGINT) AS total_patients,
                 CAST(ROW_NUMBER() OVER (PARTITION BY patient_type ORDER BY SUM(total) DESC, specialty_name) AS INTEGER) AS rank
          FROM combined GROUP BY patient_type, specialty_name) WHERE rank <= {k})"""


SQL["top_specialties"] = S.with_adapter(f"""
SELECT patient_type, rank, specialty_name, total_patients FROM {_top_sql(10)} t""")


# K9 -------------------------------------------------------------------------
def specialty_heatmap(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Top specialties per type x years, each row scaled by its own maximum.

    One aggregation to (type, specialty, year) cells; everything else is
    windows over that small table: specialty totals, the top-k cut
    (dense_rank on total then name), the year axis of each type, and the
    cells of each specialty as a year->total map for densifying.
    """
    cells = (wl.combined().groupBy("patient_type", "specialty_name", "year")
             .agg(F.sum("total").alias("total_patients")))
    spec = W.partitionBy("patient_type", "specialty_name")
    cells = cells.withColumn("row_total", F.sum("total_patients").over(spec))
    rank = F.dense_rank().over(W.partitionBy("patient_type").orderBy(F.desc("row_total"), "specialty_name"))
    top = cells.withColumn("_rank", rank).filter(F.col("_rank") <= o.heatmap_top)
    per_spec = top.select("patient_type", "specialty_name", "row_total",
                          F.collect_set("year").over(W.partitionBy("patient_type")).alias("_years"),
                          F.map_from_entries(F.collect_list(F.struct("year", "total_patients")).over(spec)).alias("_m"),
                          F.max("total_patients").over(spec).alias("_max")) \
                  .dropDuplicates(["patient_type", "specialty_name"])
    dense = per_spec.select("patient_type", "specialty_name", "row_total", "_m", "_max",
                            F.explode("_years").alias("year"))
    value = F.col("_m")[F.col("year")]
    return (dense.select("patient_type", "specialty_name", "year", value.alias("total_patients"), "row_total",
                         M.round_half(M.ratio(value, "_max"), 4).alias("norm_load"),
                         M.human_format(value).alias("label"))
            .orderBy("patient_type", F.desc("row_total"), "specialty_name", "year"))


def _fmt_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' "
            f"WHEN {x} >= 1e6 THEN printf('%.1fM', {S.rnd(f'{x} / 1e6', 1)}) "
            f"WHEN {x} >= 1e3 THEN CAST(CAST({S.rnd(f'{x} / 1e3', 0)} AS BIGINT) AS VARCHAR) || 'K' "
            f"ELSE CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) END")


SQL["specialty_heatmap"] = S.with_adapter(f"""
SELECT g.patient_type, g.specialty_name, g.year, cl.total_patients,
       CAST(SUM(cl.total_patients) OVER (PARTITION BY g.patient_type, g.specialty_name) AS BIGINT) AS row_total,
       {S.rnd(S.ratio('cl.total_patients', 'MAX(cl.total_patients) OVER (PARTITION BY g.patient_type, g.specialty_name)'), 4)} AS norm_load,
       {_fmt_sql('CAST(cl.total_patients AS DOUBLE)')} AS label
FROM g LEFT JOIN cl ON g.patient_type = cl.patient_type AND g.specialty_name = cl.specialty_name AND g.year = cl.year""",
                                      ctes=f"""
top AS (SELECT patient_type, specialty_name FROM {_top_sql(15)} t),
sub AS (SELECT c.* FROM combined c JOIN top ON c.patient_type = top.patient_type AND c.specialty_name = top.specialty_name),
cl AS (SELECT patient_type, specialty_name, year, CAST(SUM(total) AS BIGINT) AS total_patients FROM sub GROUP BY 1, 2, 3),
g AS (SELECT top.patient_type, top.specialty_name, y.year FROM top
      JOIN (SELECT DISTINCT patient_type, year FROM sub) y ON top.patient_type = y.patient_type)""")


# K10 ------------------------------------------------------------------------
def long_wait_trend(wl: WaitingList, o: Options = Options()) -> DataFrame:
    lw = wl.combined().filter(M.is_long(band=o.long_band))
    wide = _pivot_types(lw, "year_month", fill_zero=True)
    return wide.select("year_month", *[F.nullif(F.col(c), F.lit(0)).alias(c) for c in _TYPE_COLS.values()]) \
               .orderBy("year_month")


SQL["long_wait_trend"] = S.with_adapter(f"""
SELECT year_month,
       CAST(NULLIF(COALESCE(SUM(CASE WHEN patient_type = 'Inpatient' THEN total END), 0), 0) AS BIGINT) AS inpatient,
       CAST(NULLIF(COALESCE(SUM(CASE WHEN patient_type = 'Outpatient' THEN total END), 0), 0) AS BIGINT) AS outpatient
FROM combined WHERE time_bands = '18+ Months' GROUP BY year_month""")


# K11 ------------------------------------------------------------------------
def long_wait_trend_dense(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Inpatient long waits on the axis of every month present, 0 where none:
    one aggregation over all months with a conditional sum."""
    lw = M.is_long(band=o.long_band) & (F.col("patient_type") == IP)
    return (wl.combined().groupBy("year_month")
            .agg(M.sum_when(lw).cast("long").alias("inpatient_long_wait"))
            .orderBy("year_month"))


SQL["long_wait_trend_dense"] = S.with_adapter("""
SELECT year_month,
       CAST(COALESCE(SUM(CASE WHEN time_bands = '18+ Months' AND patient_type = 'Inpatient' THEN total END), 0) AS BIGINT)
         AS inpatient_long_wait
FROM combined GROUP BY year_month""")


# K12 ------------------------------------------------------------------------
def group_yoy_delta(wl: WaitingList, o: Options = Options()) -> DataFrame:
    b, c_ = o.base_year, o.compare_year
    yr = F.col("year")
    g = (wl.combined().groupBy("specialty_group")
         .agg(M.sum_when(yr == b).alias("base_total"), F.count_if(yr == b).alias("_nb"),
              M.sum_when(yr == c_).alias("compare_total"), F.count_if(yr == c_).alias("_nc"))
         .filter((F.col("_nb") > 0) & (F.col("_nc") > 0))
         .withColumn("_d", M.pct(F.col("compare_total") - F.col("base_total"), "base_total"))
         .filter(F.abs(F.col("_d")) > F.lit(o.delta_min_abs)))
    return (g.orderBy("_d", "specialty_group").limit(o.delta_rows)
            .select("specialty_group", "base_total", "compare_total",
                    M.round_half("_d", 4).alias("delta_pct")))


SQL["group_yoy_delta"] = S.with_adapter(f"""
SELECT specialty_group, base_total, compare_total, {S.rnd('d', 4)} AS delta_pct FROM (
  SELECT specialty_group, CAST(SUM(CASE WHEN year = 1999 THEN total ELSE 0 END) AS BIGINT) AS base_total,
         CAST(SUM(CASE WHEN year = 2000 THEN total ELSE 0 END) AS BIGINT) AS compare_total,
         {S.pct('SUM(CASE WHEN year = 2000 THEN total ELSE 0 END) - SUM(CASE WHEN year = 1999 THEN total ELSE 0 END)', 'SUM(CASE WHEN year = 1999 THEN total ELSE 0 END)')} AS d
  FROM combined GROUP BY specialty_group
  HAVING COUNT(*) FILTER (WHERE year = 1999) > 0 AND COUNT(*) FILTER (WHERE year = 2000) > 0)
WHERE abs(d) > 0.1 ORDER BY d, specialty_group LIMIT 18""")


# K13 ------------------------------------------------------------------------
def age_pre_post(wl: WaitingList, o: Options = Options()) -> DataFrame:
    yr = F.col("year")
    pre, post = yr.isin(list(o.pre_years)), yr.isin(list(o.post_years))
    return (wl.combined().filter(F.col("age_profile").isNotNull() & (pre | post))
            .groupBy("age_profile")
            .agg(M.sum_when(pre).alias("pre_total"), M.sum_when(post).alias("post_total"))
            .orderBy("age_profile"))


SQL["age_pre_post"] = S.with_adapter("""
SELECT age_profile, CAST(SUM(CASE WHEN year IN (1998, 1999) THEN total ELSE 0 END) AS BIGINT) AS pre_total,
       CAST(SUM(CASE WHEN year IN (2000, 2001) THEN total ELSE 0 END) AS BIGINT) AS post_total
FROM combined WHERE age_profile IS NOT NULL AND year IN (1998, 1999, 2000, 2001)
GROUP BY age_profile""")


# K14 ------------------------------------------------------------------------
def inpatient_centered_avg(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Centred 3-month mean over consecutive rows; null where a neighbour is missing."""
    m = (wl.combined().filter(F.col("patient_type") == IP).groupBy("year_month")
         .agg(F.sum("total").alias("monthly_total")))
    w = W.orderBy("year_month").rowsBetween(-1, 1)
    return (m.select("year_month", "monthly_total",
                     F.when(F.count(F.lit(1)).over(w) == 3, F.avg("monthly_total").over(w))
                     .alias("centered_avg"))
            .orderBy("year_month"))


SQL["inpatient_centered_avg"] = S.with_adapter("""
SELECT year_month, monthly_total,
       CASE WHEN COUNT(*) OVER w = 3 THEN AVG(monthly_total) OVER w END AS centered_avg
FROM (SELECT year_month, CAST(SUM(total) AS BIGINT) AS monthly_total FROM combined
      WHERE patient_type = 'Inpatient' GROUP BY year_month)
WINDOW w AS (ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")


# K15 ------------------------------------------------------------------------
def adult_child_share(wl: WaitingList, o: Options = Options()) -> DataFrame:
    g = (wl.combined().filter(F.col("adult_child").isNotNull())
         .groupBy("patient_type", "adult_child").agg(F.sum("total").alias("total_patients")))
    return (g.withColumn("pct_of_type", M.round_half(M.pct(
                "total_patients", F.sum("total_patients").over(W.partitionBy("patient_type"))), 1))
            .orderBy("patient_type", "adult_child"))


SQL["adult_child_share"] = S.with_adapter(f"""
SELECT patient_type, adult_child, CAST(SUM(total) AS BIGINT) AS total_patients,
       {S.rnd(S.pct('SUM(total)', 'SUM(SUM(total)) OVER (PARTITION BY patient_type)'), 1)} AS pct_of_type
FROM combined WHERE adult_child IS NOT NULL GROUP BY patient_type, adult_child""")


# K16 ------------------------------------------------------------------------
def age_by_year(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Total of every year for every age category that occurs at all, 0 where a year has none."""
    per = (wl.combined().filter(F.col("age_profile").isNotNull())
           .groupBy("year", "age_profile").agg(F.sum("total").alias("t")))
    cell = F.struct(F.struct("year", "age_profile"), F.col("t"))
    return (per.agg(F.collect_set("year").alias("years"), F.collect_set("age_profile").alias("ages"),
                    F.map_from_entries(F.collect_list(cell)).alias("cells"))
            .select(F.explode("years").alias("year"), "ages", "cells")
            .select("year", F.explode("ages").alias("age_profile"), "cells")
            .select("year", "age_profile", F.coalesce(
                F.element_at("cells", F.struct("year", "age_profile")), F.lit(0)).alias("total_patients"))
            .orderBy("year", "age_profile"))


SQL["age_by_year"] = S.with_adapter("""
SELECT y.year, a.age_profile, CAST(COALESCE(SUM(c.total), 0) AS BIGINT) AS total_patients
FROM (SELECT DISTINCT year FROM combined WHERE age_profile IS NOT NULL) y
CROSS JOIN (SELECT DISTINCT age_profile FROM combined WHERE age_profile IS NOT NULL) a
LEFT JOIN combined c ON c.year = y.year AND c.age_profile = a.age_profile
GROUP BY y.year, a.age_profile""")


# K17 ------------------------------------------------------------------------
def child_adult_long_wait(wl: WaitingList, o: Options = Options()) -> DataFrame:
    return (wl.combined().filter(F.col("adult_child").isin(list(ADULT_CHILD)) & M.is_long(band=o.long_band))
            .groupBy("adult_child", "year").agg(F.sum("total").alias("long_wait_total"))
            .orderBy("adult_child", "year"))


SQL["child_adult_long_wait"] = S.with_adapter("""
SELECT adult_child, year, CAST(SUM(total) AS BIGINT) AS long_wait_total FROM combined
WHERE adult_child IN ('Adult', 'Child') AND time_bands = '18+ Months' GROUP BY adult_child, year""")


# K18 ------------------------------------------------------------------------
def violin_by_year(wl: WaitingList, o: Options = Options()) -> DataFrame:
    vc = _log_counts(wl)
    medians = wide_percentiles(vc, ["year"], "x", [0.5], "_med", ranges=64).withColumnRenamed("year", "_year")
    out = D.gaussian_kde(vc, ["year"], "x", o.kde_points).join(medians, F.col("year") == F.col("_year"))
    return out.select("year", "point", M.round_half("coord", 6).alias("coord"),
                      M.round_half("density", 6).alias("density"),
                      M.round_half("_med0", 6).alias("median"), M.round_half("vmin", 6).alias("min_x"),
                      M.round_half("vmax", 6).alias("max_x")).orderBy("year", "point")


SQL["violin_by_year"] = S.with_adapter(f"""
SELECT g.year, g.point, {S.rnd('g.coord', 6)} AS coord,
       {S.rnd('SUM(exp(-0.5 * ((g.coord - x.x) / g.bw) * ((g.coord - x.x) / g.bw))) / (g.n * g.bw * sqrt(2 * pi()))', 6)} AS density,
       {S.rnd('g.med', 6)} AS median, {S.rnd('g.vmin', 6)} AS min_x, {S.rnd('g.vmax', 6)} AS max_x
FROM g JOIN x ON g.year = x.year
GROUP BY g.year, g.point, g.coord, g.n, g.bw, g.med, g.vmin, g.vmax""", ctes="""
x AS (SELECT year, ln(1 + total) AS x FROM combined),
st AS (SELECT year, COUNT(*) AS n, MIN(x) AS vmin, MAX(x) AS vmax, quantile_cont(x, 0.5) AS med,
              stddev_samp(x) * pow(COUNT(*), -0.2) AS bw FROM x GROUP BY year),
g AS (SELECT st.*, CAST(t.i AS INTEGER) AS point, st.vmin + t.i * ((st.vmax - st.vmin) / 99.0) AS coord
      FROM st CROSS JOIN range(100) t(i))""")


# K19 ------------------------------------------------------------------------
def avg_wait_by_year(c: DataFrame) -> DataFrame:
    """Mean wait-band ordinal per year, over records (null ordinals skipped)."""
    return c.groupBy("year").agg(F.avg("wait_rank").alias("avg_wait_rank")) \
            .filter(F.col("avg_wait_rank").isNotNull())


def avg_wait_trend(wl: WaitingList, o: Options = Options()) -> DataFrame:
    a = avg_wait_by_year(wl.combined())
    allw = W.partitionBy()
    slope = F.regr_slope("avg_wait_rank", F.col("year").cast("double")).over(allw)
    icpt = F.regr_intercept("avg_wait_rank", F.col("year").cast("double")).over(allw)
    return (a.select("year", M.round_half("avg_wait_rank", 6).alias("avg_wait_rank"),
                     M.round_half(slope * F.col("year") + icpt, 6).alias("fitted"),
                     M.round_half(slope, 6).alias("slope"), M.round_half(icpt, 4).alias("intercept"))
            .orderBy("year"))


SQL["avg_wait_trend"] = S.with_adapter(f"""
SELECT year, {S.rnd('a', 6)} AS avg_wait_rank, {S.rnd('s * year + i', 6)} AS fitted,
       {S.rnd('s', 6)} AS slope, {S.rnd('i', 4)} AS intercept
FROM (SELECT year, a, regr_slope(a, CAST(year AS DOUBLE)) OVER () AS s,
             regr_intercept(a, CAST(year AS DOUBLE)) OVER () AS i
      FROM (SELECT year, AVG(wait_rank) AS a FROM combined GROUP BY year) WHERE a IS NOT NULL)""")


# K20 ------------------------------------------------------------------------
def chi2_residuals(wl: WaitingList, o: Options = Options()) -> DataFrame:
    ex = expected(crosstab_long(wl.combined(), "adult_child", "time_bands"), "adult_child", "time_bands")
    return ex.select("adult_child", "time_bands", "observed",
                     M.round_half("expected", 4).alias("expected"),
                     M.round_half("std_residual", 4).alias("std_residual")) \
             .orderBy("adult_child", "time_bands")


SQL["chi2_residuals"] = S.with_adapter(f"""
SELECT adult_child, time_bands, observed, {S.rnd('e', 4)} AS expected, {S.rnd('(observed - e) / sqrt(e)', 4)} AS std_residual
FROM (SELECT *, CAST(SUM(observed) OVER (PARTITION BY adult_child) AS DOUBLE)
               * CAST(SUM(observed) OVER (PARTITION BY time_bands) AS DOUBLE)
               / CAST(SUM(observed) OVER () AS DOUBLE) AS e FROM full_ct)""", ctes="""
cells AS (SELECT adult_child, time_bands, COUNT(*) AS o FROM combined
          WHERE adult_child IS NOT NULL AND time_bands IS NOT NULL GROUP BY 1, 2),
full_ct AS (SELECT r.adult_child, k.time_bands, CAST(COALESCE(cells.o, 0) AS BIGINT) AS observed
            FROM (SELECT DISTINCT adult_child FROM cells) r CROSS JOIN (SELECT DISTINCT time_bands FROM cells) k
            LEFT JOIN cells ON cells.adult_child = r.adult_child AND cells.time_bands = k.time_bands)""")


# K21 ------------------------------------------------------------------------
def specialty_year(c: DataFrame) -> DataFrame:
    """Specialty-year grain: total, record count, mean wait ordinal (dropna)."""
    return (c.groupBy("specialty_name", "year")
            .agg(F.sum("total").alias("Total"), F.count(F.lit(1)).alias("Records"),
                 F.avg("wait_rank").alias("AvgWait"))
            .filter(F.col("AvgWait").isNotNull()))


def corr_long(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson matrix in long form (var_x, var_y, corr) from one aggregation."""
    pairs = [(a, b) for a in names for b in names]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
                   for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                              M.round_half(F.col(f"{a}__{b}"), 6).alias("corr")) for a, b in pairs])
    return agg.select(F.inline(rows))


def corr_matrix(wl: WaitingList, o: Options = Options()) -> DataFrame:
    sy = specialty_year(wl.combined()).select(F.col("year").alias("Year"), "Total", "AvgWait")
    return corr_long(sy, ["Year", "Total", "AvgWait"])


def _corr_sql(names: list[str]) -> str:
    parts = []
    for a in names:
        for b in names:
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {S.rnd(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 6)} AS corr FROM sy")
    return S.with_adapter("\nUNION ALL\n".join(parts), ctes="""
sy AS (SELECT specialty_name, year AS Year, SUM(total) AS Total, COUNT(*) AS Records, AVG(wait_rank) AS AvgWait
       FROM combined GROUP BY specialty_name, year HAVING AVG(wait_rank) IS NOT NULL)""")


SQL["corr_matrix"] = _corr_sql(["Year", "Total", "AvgWait"])


# K22 ------------------------------------------------------------------------
def group_bubble(wl: WaitingList, o: Options = Options()) -> DataFrame:
    g = (wl.combined().groupBy("patient_type", "specialty_group")
         .agg(F.sum("total").alias("total_patients"), F.count(F.lit(1)).alias("records"),
              M.long_wait_sum(band=o.long_band).alias("long_wait"))
         .withColumn("lw_pct", M.round_half(M.pct("long_wait", "total_patients"), 1)))
    t = W.partitionBy("patient_type")
    return (g.select("patient_type", "specialty_group", "total_patients", "records", "long_wait", "lw_pct",
                     M.round_half(F.col("records") / F.max("records").over(t) * F.lit(700.0) + F.lit(60.0), 4)
                     .alias("bubble_size"),
                     M.round_half(F.avg("lw_pct").over(t), 4).alias("avg_lw_pct"))
            .orderBy("patient_type", "specialty_group"))


SQL["group_bubble"] = S.with_adapter(f"""
SELECT patient_type, specialty_group, total_patients, records, long_wait, lw_pct,
       {S.rnd('CAST(records AS DOUBLE) / MAX(records) OVER (PARTITION BY patient_type) * 700.0 + 60.0', 4)} AS bubble_size,
       {S.rnd('AVG(lw_pct) OVER (PARTITION BY patient_type)', 4)} AS avg_lw_pct
FROM (SELECT patient_type, specialty_group, CAST(SUM(total) AS BIGINT) AS total_patients, COUNT(*) AS records,
             CAST({S.lw()} AS BIGINT) AS long_wait, {S.rnd(S.pct(S.lw(), 'SUM(total)'), 1)} AS lw_pct
      FROM combined GROUP BY patient_type, specialty_group)""")


# K23 ------------------------------------------------------------------------
def group_top15(wl: WaitingList, o: Options = Options()) -> DataFrame:
    return (wl.combined().groupBy("specialty_group")
            .agg(F.sum("total").alias("total_patients"), M.long_wait_sum(band=o.long_band).alias("long_wait"))
            .withColumn("lw_pct", M.round_half(M.pct("long_wait", "total_patients"), 1))
            .orderBy(F.desc("total_patients"), "specialty_group").limit(o.group_top))


SQL["group_top15"] = S.with_adapter(f"""
SELECT specialty_group, CAST(SUM(total) AS BIGINT) AS total_patients, CAST({S.lw()} AS BIGINT) AS long_wait,
       {S.rnd(S.pct(S.lw(), 'SUM(total)'), 1)} AS lw_pct
FROM combined GROUP BY specialty_group ORDER BY total_patients DESC, specialty_group LIMIT 15""")


# K24 ------------------------------------------------------------------------
def kpis(wl: WaitingList, o: Options = Options()) -> DataFrame:
    tp = F.col("patient_type")
    return (wl.combined().agg(
        F.sum("total").alias("total_patients"),
        M.sum_when(tp == IP).alias("inpatient_total"),
        M.sum_when(tp == OP).alias("outpatient_total"),
        M.long_wait_sum(band=o.long_band).alias("long_wait"),
        F.count_distinct("specialty_name").alias("specialties"))
        .withColumn("long_wait_pct", M.round_half(M.pct("long_wait", "total_patients"), 1)))


SQL["kpis"] = S.with_adapter(f"""
SELECT CAST(SUM(total) AS BIGINT) AS total_patients,
       CAST(SUM(CASE WHEN patient_type = 'Inpatient' THEN total ELSE 0 END) AS BIGINT) AS inpatient_total,
       CAST(SUM(CASE WHEN patient_type = 'Outpatient' THEN total ELSE 0 END) AS BIGINT) AS outpatient_total,
       CAST({S.lw()} AS BIGINT) AS long_wait, COUNT(DISTINCT specialty_name) AS specialties,
       {S.rnd(S.pct(S.lw(), 'SUM(total)'), 1)} AS long_wait_pct
FROM combined""")


# K26 ------------------------------------------------------------------------
def case_type_pct(wl: WaitingList, o: Options = Options()) -> DataFrame:
    ip = wl.combined().filter((F.col("patient_type") == IP) & F.col("case_type").isNotNull())
    dense = _band_totals(ip, "case_type")
    return (dense.select("case_type", "time_bands", "band_order", "total_patients",
                         M.round_half(M.pct("total_patients", F.sum("total_patients")
                                            .over(W.partitionBy("case_type"))), 1).alias("pct"))
            .orderBy("case_type", "band_order"))


SQL["case_type_pct"] = S.with_adapter(f"""
SELECT case_type, time_bands, band_order, total_patients,
       {S.rnd(S.pct('total_patients', 'SUM(total_patients) OVER (PARTITION BY case_type)'), 1)} AS pct
FROM (SELECT t.case_type, b.time_bands, b.band_order, CAST(COALESCE(a.s, 0) AS BIGINT) AS total_patients
      FROM (SELECT DISTINCT case_type FROM combined WHERE patient_type = 'Inpatient' AND case_type IS NOT NULL) t
      CROSS JOIN (VALUES {_BAND_VALUES}) b(time_bands, band_order)
      LEFT JOIN (SELECT case_type, time_bands, SUM(total) AS s FROM combined
                 WHERE patient_type = 'Inpatient' AND case_type IS NOT NULL GROUP BY 1, 2) a
        ON a.case_type = t.case_type AND a.time_bands = b.time_bands)""")


PRODUCTS = {
    "annual_pivot": annual_pivot,
    "yoy_pct_change": yoy_pct_change,
    "monthly_pivot": monthly_pivot,
    "histogram_by_type": histogram_by_type,
    "box_by_year": box_by_year,
    "descriptive_table": descriptive_table,
    "band_pct_by_type": band_pct_by_type,
    "top_specialties": top_specialties,
    "specialty_heatmap": specialty_heatmap,
    "long_wait_trend": long_wait_trend,
    "long_wait_trend_dense": long_wait_trend_dense,
    "group_yoy_delta": group_yoy_delta,
    "age_pre_post": age_pre_post,
    "inpatient_centered_avg": inpatient_centered_avg,
    "adult_child_share": adult_child_share,
    "age_by_year": age_by_year,
    "child_adult_long_wait": child_adult_long_wait,
    "violin_by_year": violin_by_year,
    "avg_wait_trend": avg_wait_trend,
    "chi2_residuals": chi2_residuals,
    "corr_matrix": corr_matrix,
    "group_bubble": group_bubble,
    "group_top15": group_top15,
    "kpis": kpis,
    "case_type_pct": case_type_pct,
}
