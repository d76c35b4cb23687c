"""Hypothesis tests and correlations (statistics as Spark aggregates).

Every test starts from a small pre-aggregated input so it can run either on
the canonical rows or on the grains of one pass over them (``plans.summary``):

* value counts ``(key, total, cnt)`` for the rank tests,
* record counts per (adult_child, time_bands) cell for the chi-square test,
* wait-ordinal sums per year / specialty-year for the correlations.

Tail probabilities are JVM expressions too (``functions.tails``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions import tails as TL
from queuelens.functions import measures as M
from queuelens.functions.constants import (PATIENT_TYPES, SIGNIFICANCE_ALPHA,
                                           SIGNIFICANCE_LABELS, STRENGTH_CUTS, STRENGTH_LABELS,
                                           TREND_TEST_LABELS)
from queuelens.functions.options import Options
from queuelens.operators import distribution as D
from queuelens.operators.contingency import chi_square, densify_cells
from queuelens.operators.model import WaitingList
from queuelens.operators.ranktests import kruskal_wallis, mann_whitney, pearson, spearman, with_mann_whitney_p
from queuelens.plans import sqlkit as S
from queuelens.plans.summary import VALUE, Grain, grains, mean_wait, value_counts

SQL: dict[str, str] = {}
IP = PATIENT_TYPES[0]


# inputs -----------------------------------------------------------------------
def year_counts(c: DataFrame, o: Options) -> DataFrame:
    df = c.filter(F.col("year").isin(list(o.years))) if o.years else c
    return D.value_counts(df, ["year"], "total")


def type_counts(c: DataFrame) -> DataFrame:
    return D.value_counts(c, ["patient_type"], "total")


def cell_counts(c: DataFrame) -> DataFrame:
    """(adult_child, time_bands, observed) record counts, null keys left out."""
    return (c.filter(F.col("adult_child").isNotNull() & F.col("time_bands").isNotNull())
            .groupBy("adult_child", "time_bands").agg(F.count(F.lit(1)).alias("observed")))


def wait_by_year(c: DataFrame) -> DataFrame:
    """(year, avg_wait_rank): mean over records, null ordinals skipped."""
    return (c.groupBy("year").agg(F.avg("wait_rank").alias("avg_wait_rank"))
            .filter(F.col("avg_wait_rank").isNotNull()))


def spec_year(c: DataFrame) -> DataFrame:
    """(specialty_name, year, Total, Records, AvgWait), rows without a mean dropped."""
    return (c.groupBy("specialty_name", "year")
            .agg(F.sum("total").alias("Total"), F.count(F.lit(1)).alias("Records"),
                 F.avg("wait_rank").alias("AvgWait"))
            .filter(F.col("AvgWait").isNotNull()))


def _dense_cells(cells: DataFrame) -> DataFrame:
    return densify_cells(cells, "adult_child", "time_bands")


# statistics -------------------------------------------------------------------
def kw_frame(vc_year: DataFrame) -> DataFrame:
    return kruskal_wallis(vc_year, "year", "total")


def mw_frame(vc_type: DataFrame) -> DataFrame:
    return mann_whitney(vc_type, "patient_type", IP, "total")


def chi2_frame(cells: DataFrame) -> DataFrame:
    return chi_square(_dense_cells(cells), "adult_child", "time_bands")


def spearman_frame(wy: DataFrame) -> DataFrame:
    return spearman(wy, "year", "avg_wait_rank")


def pearson_frame(sy: DataFrame) -> DataFrame:
    return pearson(sy, "Total", "AvgWait")


P_DIGITS = 10


def _shown(df: DataFrame) -> DataFrame:
    """Test statistics to 6 decimals and the p-value to P_DIGITS."""
    return df.select(*(M.round_half(c, P_DIGITS if c == "p_value" else 6).alias(c) if c in ("h", "u", "z", "chi2", "rho", "r", "p_value")
                       else F.col(c) for c in df.columns))


def kruskal_h(wl: WaitingList, o: Options = Options()) -> DataFrame:
    k = kw_frame(year_counts(wl.combined(), o))
    return k.select(M.round_half("h", 4).alias("h"), "dof", "n")


def kruskal_p(wl: WaitingList, o: Options = Options()) -> DataFrame:
    k = kw_frame(year_counts(wl.combined(), o))
    return _shown(TL.with_chi2_sf(k.select("h", "dof"), "h", "dof", "p_value"))


_RANKS = """
r AS (SELECT {key} AS g, total,
             RANK() OVER (ORDER BY total) + (COUNT(*) OVER (PARTITION BY total) - 1) / 2.0 AS mr
      FROM combined),
ties AS (SELECT SUM(c * c * c - c) AS tt FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM combined GROUP BY total))"""

SQL["kruskal_h"] = S.with_adapter(f"""
SELECT {S.rnd('(12.0 / (s.n * (s.n + 1.0)) * s.srn - 3.0 * (s.n + 1.0)) / (1.0 - ties.tt / (s.n * s.n * s.n - s.n))', 4)} AS h,
       s.k - 1 AS dof, CAST(s.n AS BIGINT) AS n
FROM s, ties""", ctes=_RANKS.format(key="year") + """,
g AS (SELECT g, CAST(COUNT(*) AS DOUBLE) AS n, SUM(mr) AS rs FROM r GROUP BY g),
s AS (SELECT SUM(rs * rs / n) AS srn, SUM(n) AS n, COUNT(*) AS k FROM g)""")


def mann_whitney_u(wl: WaitingList, o: Options = Options()) -> DataFrame:
    m = mw_frame(type_counts(wl.combined()))
    return m.select("u", "n1", "n2", M.round_half("z", 6).alias("z"))


def mann_whitney_p(wl: WaitingList, o: Options = Options()) -> DataFrame:
    m = mw_frame(type_counts(wl.combined()))
    return _shown(with_mann_whitney_p(m).select("u", "z", "p_value"))


def mann_whitney_years(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Per specialty: do the yearly totals of the two patient types differ? A few years a sample, so the
    p-values are exact unless totals tie."""
    yearly = (wl.combined().groupBy("specialty_name", "patient_type", "year").agg(F.sum("total").alias("total"))
              .withColumn(D.CNT, F.lit(1).cast("long")))
    m = with_mann_whitney_p(mann_whitney(yearly, "patient_type", IP, "total", by=["specialty_name"]))
    return m.select("specialty_name", "u", "n1", "n2", "exact", M.round_half("p_value", P_DIGITS).alias("p_value"))


SQL["mann_whitney_u"] = S.with_adapter(f"""
SELECT r1 - n1 * (n1 + 1) / 2.0 AS u, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       {S.rnd('greatest(greatest(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) - n1 * n2 / 2.0 - 0.5, 0.0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1))))', 6)} AS z
FROM s, ties""", ctes=_RANKS.format(key="patient_type") + """,
s AS (SELECT SUM(CASE WHEN g = 'Inpatient' THEN mr END) AS r1,
             CAST(COUNT(*) FILTER (WHERE g = 'Inpatient') AS DOUBLE) AS n1,
             CAST(COUNT(*) FILTER (WHERE g <> 'Inpatient') AS DOUBLE) AS n2 FROM r)""")


def chi2_stat(wl: WaitingList, o: Options = Options()) -> DataFrame:
    c = chi2_frame(cell_counts(wl.combined()))
    return c.select(M.round_half("chi2", 4).alias("chi2"), "dof", "n")


def cramers_v(wl: WaitingList, o: Options = Options()) -> DataFrame:
    c = chi2_frame(cell_counts(wl.combined()))
    return c.select(M.round_half("cramers_v", 6).alias("cramers_v"),
                    M.classify_above("cramers_v", STRENGTH_CUTS, STRENGTH_LABELS).alias("strength"))


def chi2_p(wl: WaitingList, o: Options = Options()) -> DataFrame:
    c = chi2_frame(cell_counts(wl.combined()))
    return _shown(TL.with_chi2_sf(c.select("chi2", "dof"), "chi2", "dof", "p_value"))


_CHI_CTES = """
cells AS (SELECT adult_child, time_bands, COUNT(*) AS o FROM combined
          WHERE adult_child IS NOT NULL AND time_bands IS NOT NULL GROUP BY 1, 2),
ct AS (SELECT r.adult_child, k.time_bands, CAST(COALESCE(cells.o, 0) AS DOUBLE) AS o
       FROM (SELECT DISTINCT adult_child FROM cells) r CROSS JOIN (SELECT DISTINCT time_bands FROM cells) k
       LEFT JOIN cells ON cells.adult_child = r.adult_child AND cells.time_bands = k.time_bands),
ex AS (SELECT o, SUM(o) OVER (PARTITION BY adult_child) * SUM(o) OVER (PARTITION BY time_bands) / SUM(o) OVER () AS e
       FROM ct),
dims AS (SELECT COUNT(DISTINCT adult_child) AS nr, COUNT(DISTINCT time_bands) AS nc, SUM(o) AS n FROM ct),
adj AS (SELECT e, CASE WHEN (SELECT (nr - 1) * (nc - 1) FROM dims) = 1
                       THEN o + least(0.5, abs(e - o)) * sign(e - o) ELSE o END AS oa FROM ex),
chi AS (SELECT SUM((oa - e) * (oa - e) / e) AS chi2 FROM adj)"""

SQL["chi2_stat"] = S.with_adapter(f"""
SELECT {S.rnd('chi.chi2', 4)} AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n
FROM chi, dims""", ctes=_CHI_CTES)

SQL["cramers_v"] = S.with_adapter(f"""
SELECT {S.rnd('sqrt(chi.chi2 / (n * (least(nr, nc) - 1)))', 6)} AS cramers_v,
       CASE WHEN sqrt(chi.chi2 / (n * (least(nr, nc) - 1))) > 0.3 THEN 'Strong'
            WHEN sqrt(chi.chi2 / (n * (least(nr, nc) - 1))) > 0.1 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM chi, dims""", ctes=_CHI_CTES)


def spearman_year(wl: WaitingList, o: Options = Options()) -> DataFrame:
    s = spearman_frame(wait_by_year(wl.combined()))
    return s.select(M.round_half("rho", 6).alias("rho"), "n")


def spearman_p(wl: WaitingList, o: Options = Options()) -> DataFrame:
    s = spearman_frame(wait_by_year(wl.combined()))
    return _shown(TL.with_corr_two_sided(s.select("rho", "n"), "rho", "n", "p_value"))


_SPEARMAN = """
SELECT {rho} AS rho, COUNT(*) AS n FROM (
  SELECT RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM src)"""

SQL["spearman_year"] = S.with_adapter(_SPEARMAN.format(rho=S.rnd("corr(rx, ry)", 6)), ctes="""
src AS (SELECT year AS x, a AS y FROM (SELECT year, AVG(wait_rank) AS a FROM combined GROUP BY year)
        WHERE a IS NOT NULL)""")


def pearson_specialty_year(wl: WaitingList, o: Options = Options()) -> DataFrame:
    p = pearson_frame(spec_year(wl.combined()))
    return p.select(M.round_half("r", 6).alias("r"), "n")


def pearson_p(wl: WaitingList, o: Options = Options()) -> DataFrame:
    p = pearson_frame(spec_year(wl.combined()))
    return _shown(TL.with_corr_two_sided(p.select("r", "n"), "r", "n", "p_value"))


_SPEC_YR = """
sy AS (SELECT specialty_name, year, SUM(total) AS Total, COUNT(*) AS Records, AVG(wait_rank) AS AvgWait
       FROM combined GROUP BY specialty_name, year HAVING AVG(wait_rank) IS NOT NULL)"""

SQL["pearson_specialty_year"] = S.with_adapter(f"""
SELECT {S.rnd('corr(CAST(Total AS DOUBLE), AvgWait)', 6)} AS r, COUNT(*) AS n FROM sy""", ctes=_SPEC_YR)


def trend_line(wl: WaitingList, o: Options = Options()) -> DataFrame:
    a = wait_by_year(wl.combined())
    x = F.col("year").cast("double")
    return a.agg(M.round_half(F.regr_slope("avg_wait_rank", x), 6).alias("slope"),
                 M.round_half(F.regr_intercept("avg_wait_rank", x), 4).alias("intercept"),
                 F.count(F.lit(1)).alias("n"))


SQL["trend_line"] = S.with_adapter(f"""
SELECT {S.rnd('regr_slope(a, CAST(year AS DOUBLE))', 6)} AS slope,
       {S.rnd('regr_intercept(a, CAST(year AS DOUBLE))', 4)} AS intercept, COUNT(*) AS n
FROM (SELECT year, AVG(wait_rank) AS a FROM combined GROUP BY year) WHERE a IS NOT NULL""")


# Tail probabilities in SQL: finite sums where the degrees of freedom allow, else a series.
def _chi2_sql(x: str, k: str) -> str:
    """P(X > x): the finite sum for even k, one minus the incomplete gamma series for odd k."""
    even = (f"list_sum(list_transform(range(CAST({k} AS BIGINT) // 2), "
            f"lambda j: exp(j * ln({x} / 2.0) - {x} / 2.0 - lgamma(j + 1))))")
    odd = (f"1.0 - list_sum(list_transform(range(2000), "
           f"lambda j: exp((j + {k} / 2.0) * ln({x} / 2.0) - {x} / 2.0 - lgamma(j + {k} / 2.0 + 1))))")
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {k} % 2 = 0 THEN {even} ELSE {odd} END"


def _normal_sql(z: str) -> str:
    """2 P(Z > z) = P(chi-square with 1 degree > z^2); beyond z = 38 less than the least double."""
    return f"CASE WHEN {z} >= 38 THEN 0.0 ELSE {_chi2_sql(f'({z} * {z})', '1')} END"


def _corr_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: finite sums of powers of cos for Student's t with n - 2 degrees."""
    v, c = f"({n} - 2)", f"sqrt(1.0 - {r} * {r})"
    odd = (f"asin(abs({r})) + CASE WHEN {v} = 1 THEN 0.0 ELSE abs({r}) * list_sum(list_transform("
           f"range(CAST(({v} - 1) // 2 AS BIGINT)), lambda j: exp((2 * j + 1) * ln({c}) + lgamma(j + 1) + lgamma(1.5) "
           f"- lgamma(j + 1.5)))) END")
    even = (f"abs({r}) * list_sum(list_transform(range(CAST({v} // 2 AS BIGINT)), "
            f"lambda j: exp(2 * j * ln({c}) + lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1))))")
    return (f"CASE WHEN {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
            f"WHEN {v} % 2 = 1 THEN 1.0 - 2.0 / pi() * ({odd}) ELSE 1.0 - ({even}) END")


_KW = _RANKS.format(key="year") + """,
g AS (SELECT g, CAST(COUNT(*) AS DOUBLE) AS n, SUM(mr) AS rs FROM r GROUP BY g),
kw AS (SELECT (12.0 / (n * (n + 1.0)) * srn - 3.0 * (n + 1.0)) / (1.0 - tt / (n * n * n - n)) AS h, k - 1 AS dof, n
       FROM (SELECT SUM(rs * rs / n) AS srn, SUM(n) AS n, COUNT(*) AS k FROM g), ties)"""
_MW = _RANKS.format(key="patient_type") + """,
mw AS (SELECT r1 - n1 * (n1 + 1) / 2.0 AS u, n1,
              greatest(abs(r1 - n1 * (n1 + n2 + 1) / 2.0) - 0.5, 0.0)
                / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1)))) AS z
       FROM (SELECT SUM(CASE WHEN g = 'Inpatient' THEN mr END) AS r1,
                    CAST(COUNT(*) FILTER (WHERE g = 'Inpatient') AS DOUBLE) AS n1,
                    CAST(COUNT(*) FILTER (WHERE g <> 'Inpatient') AS DOUBLE) AS n2 FROM r), ties)"""
_CHI = _CHI_CTES + """,
ch AS (SELECT chi.chi2, (nr - 1) * (nc - 1) AS dof, sqrt(chi.chi2 / (n * (least(nr, nc) - 1))) AS v, n FROM chi, dims)"""
_SP = """
sp AS (SELECT corr(rx, ry) AS rho, COUNT(*) AS n FROM (
         SELECT RANK() OVER (ORDER BY year) AS rx,
                RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS ry
         FROM (SELECT year, AVG(wait_rank) AS a FROM combined GROUP BY year HAVING AVG(wait_rank) IS NOT NULL)))"""
_PR = _SPEC_YR + """,
pr AS (SELECT corr(CAST(Total AS DOUBLE), AvgWait) AS r, COUNT(*) AS n FROM sy)"""

SQL["kruskal_p"] = S.with_adapter(f"""
SELECT {S.rnd('h', 6)} AS h, dof, {S.rnd(_chi2_sql('h', 'dof'), P_DIGITS)} AS p_value FROM kw""", ctes=_KW)
SQL["mann_whitney_p"] = S.with_adapter(f"""
SELECT {S.rnd('u', 6)} AS u, {S.rnd('z', 6)} AS z, {S.rnd(_normal_sql('z'), P_DIGITS)} AS p_value FROM mw""", ctes=_MW)
SQL["chi2_p"] = S.with_adapter(f"""
SELECT {S.rnd('chi2', 6)} AS chi2, CAST(dof AS BIGINT) AS dof,
       {S.rnd(_chi2_sql('chi2', 'dof'), P_DIGITS)} AS p_value FROM ch""", ctes=_CHI)
SQL["spearman_p"] = S.with_adapter(f"""
SELECT {S.rnd('rho', 6)} AS rho, n, {S.rnd(_corr_sql('rho', 'n'), P_DIGITS)} AS p_value FROM sp""", ctes=_SP)
SQL["pearson_p"] = S.with_adapter(f"""
SELECT {S.rnd('r', 6)} AS r, n, {S.rnd(_corr_sql('r', 'n'), P_DIGITS)} AS p_value FROM pr""", ctes=_PR)


# All orders of the two samples of a specialty, one bit per place in the order of totals.
SQL["mann_whitney_years"] = S.with_adapter(f"""
SELECT specialty_name, u, n1, n2, exact, {S.rnd(f"CASE WHEN u IS NULL THEN NULL WHEN exact THEN least(1.0, 2.0 * below / every) ELSE {_normal_sql('z')} END", P_DIGITS)} AS p_value
FROM (SELECT s.*, tt = 0 AND n1 IS NOT NULL AND n2 IS NOT NULL AS exact,
             greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0.0)
               / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z,
             w.below, w.every
      FROM s LEFT JOIN w USING (specialty_name))""", ctes=f"""
t AS (SELECT specialty_name, patient_type, year, SUM(total) AS total FROM combined GROUP BY 1, 2, 3),
ties AS (SELECT specialty_name, SUM(c * c * c - c) AS tt
         FROM (SELECT specialty_name, total, CAST(COUNT(*) AS DOUBLE) AS c FROM t GROUP BY 1, 2) GROUP BY 1),
sizes AS (SELECT specialty_name, COUNT(*) FILTER (WHERE patient_type = '{IP}') AS n1,
                 COUNT(*) FILTER (WHERE patient_type <> '{IP}') AS n2 FROM t GROUP BY 1),
us AS (SELECT a.specialty_name, SUM(CASE WHEN a.total > b.total THEN 1.0 WHEN a.total = b.total THEN 0.5 ELSE 0.0 END) AS u
       FROM t a JOIN t b ON a.specialty_name = b.specialty_name AND a.patient_type = '{IP}' AND b.patient_type <> '{IP}'
       GROUP BY 1),
s AS (SELECT specialty_name, CAST(u AS DOUBLE) AS u, nullif(n1, 0) AS n1, nullif(n2, 0) AS n2, tt
      FROM sizes LEFT JOIN us USING (specialty_name) JOIN ties USING (specialty_name)),
masks AS (SELECT m, bit_count(m) AS ones, list_sum(list_transform(range(16), lambda i: i * ((m >> i) & 1))) AS places
          FROM (SELECT CAST(range AS BIGINT) AS m FROM range(65536))),
w AS (SELECT specialty_name, COUNT(*) FILTER (WHERE places - n1 * (n1 - 1) / 2.0 <= least(u, n1 * n2 - u)) AS below,
             COUNT(*) AS every
      FROM s JOIN masks ON ones = n1 AND m < (1 << (n1 + n2)) GROUP BY 1)""")


# K25 --------------------------------------------------------------------------
def tests_table(vc_year, vc_type, cells, wy, sy) -> DataFrame:
    """One row per test: test, statistic, p_value, dof (or n), conclusion.

    The one-row statistics are unioned first and the tail probability of
    each row is a JVM expression chosen by the test kind.
    """
    def row(df, name, stat, kind, p_stat, p_param, dof):
        known = F.col("p_value") if kind == "known" else F.lit(None)
        return df.select(F.lit(name).alias("test"), F.col(stat).cast("double").alias("statistic"),
                         F.lit(kind).alias("_kind"), known.cast("double").alias("_known"), F.col(p_stat).cast("double").alias("_ps"),
                         F.col(p_param).cast("double").alias("_pp"),
                         F.col(dof).cast("double").alias("dof_or_n"))

    kw = kw_frame(vc_year)
    mw = with_mann_whitney_p(mw_frame(vc_type))
    chi = chi2_frame(cells)
    sp = spearman_frame(wy)
    pr = pearson_frame(sy)
    rows = (row(kw, "kruskal_wallis", "h", "chi2", "h", "dof", "dof")
            .unionByName(row(mw, "mann_whitney", "u", "known", "z", "n1", "n1"))
            .unionByName(row(chi, "chi_square", "chi2", "chi2", "chi2", "dof", "dof"))
            .unionByName(row(chi, "cramers_v", "cramers_v", "chi2", "chi2", "dof", "n"))
            .unionByName(row(sp, "spearman", "rho", "corr", "rho", "n", "n"))
            .unionByName(row(pr, "pearson", "r", "corr", "r", "n", "n")))
    kind = F.col("_kind")
    rows = TL.with_chi2_sf(rows, "_ps", "_pp", "_p_chi2")
    rows = TL.with_corr_two_sided(rows, "_ps", "_pp", "_p_corr")
    p = (F.when(kind == "chi2", F.col("_p_chi2")).when(kind == "known", F.col("_known"))
         .when(kind == "corr", F.col("_p_corr")))
    low = F.col("p_value") < F.lit(SIGNIFICANCE_ALPHA)

    def told(labels):
        return F.when(low, F.lit(labels[0])).otherwise(F.lit(labels[1]))
    conclusion = (F.when(F.col("test") == "spearman", told(TREND_TEST_LABELS))
                  .when(F.col("test") == "cramers_v", M.classify_above("statistic", STRENGTH_CUTS, STRENGTH_LABELS))
                  .otherwise(told(SIGNIFICANCE_LABELS)))
    return (rows.select("test", "statistic", p.alias("p_value"), "dof_or_n")
            .withColumn("conclusion", conclusion))


# Grains of the tests: value counts, cells and specialty-years apart, so none comes near the rows.
TEST_GRAINS = {"values": ["patient_type", "year", VALUE], "people": ["adult_child", "time_bands"],
               "specialties": ["specialty_name", "year", "time_bands"]}


def tests_from_grains(g: dict[str, Grain], o: Options) -> DataFrame:
    """All tests from grains with at least the keys of TEST_GRAINS."""
    values = g["values"]
    of_years = Grain(values.frame.filter(F.col("year").isin(list(o.years)))) if o.years else values
    cells = (g["people"].frame.filter(F.col("adult_child").isNotNull() & F.col("time_bands").isNotNull())
             .groupBy("adult_child", "time_bands").agg(F.sum("records").alias("observed")))
    spec = g["specialties"].frame
    wy = spec.groupBy("year").agg(mean_wait().alias("avg_wait_rank")).filter(F.col("avg_wait_rank").isNotNull())
    sy = (spec.groupBy("specialty_name", "year")
          .agg(F.sum("total").alias("Total"), F.sum("records").alias("Records"), mean_wait().alias("AvgWait"))
          .filter(F.col("AvgWait").isNotNull()))
    return tests_table(value_counts(of_years, "year"), value_counts(values, "patient_type"), cells, wy, sy)


def stat_tests(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """All tests from one pass over the rows."""
    t = tests_from_grains(grains(wl.combined(), **TEST_GRAINS), o)
    return t.select("test", M.round_half("statistic", 6).alias("statistic"),
                    M.round_half("p_value", P_DIGITS).alias("p_value"), "dof_or_n", "conclusion")


def _verdict_sql(p: str, labels: tuple) -> str:
    return f"CASE WHEN {p} < {SIGNIFICANCE_ALPHA} THEN '{labels[0]}' ELSE '{labels[1]}' END"


def _test_sql(ctes: str, source: str, name: str, stat: str, p: str, count: str, labels=SIGNIFICANCE_LABELS) -> str:
    verdict = _verdict_sql("p", labels) if labels is not None else (
        f"CASE WHEN {stat} > {STRENGTH_CUTS[0]} THEN '{STRENGTH_LABELS[0]}' "
        f"WHEN {stat} > {STRENGTH_CUTS[1]} THEN '{STRENGTH_LABELS[1]}' ELSE '{STRENGTH_LABELS[2]}' END")
    return (f"SELECT * FROM (WITH {ctes.strip()} SELECT '{name}' AS test, {S.rnd(stat, 6)} AS statistic, "
            f"{S.rnd('p', P_DIGITS)} AS p_value, CAST({count} AS DOUBLE) AS dof_or_n, {verdict} AS conclusion "
            f"FROM (SELECT *, {p} AS p FROM {source}))")


SQL["stat_tests"] = S.with_adapter("\nUNION ALL\n".join((
    _test_sql(_KW, "kw", "kruskal_wallis", "h", _chi2_sql("h", "dof"), "dof"),
    _test_sql(_MW, "mw", "mann_whitney", "u", _normal_sql("z"), "n1"),
    _test_sql(_CHI, "ch", "chi_square", "chi2", _chi2_sql("chi2", "dof"), "dof"),
    _test_sql(_CHI, "ch", "cramers_v", "v", _chi2_sql("chi2", "dof"), "n", labels=None),
    _test_sql(_SP, "sp", "spearman", "rho", _corr_sql("rho", "n"), "n", TREND_TEST_LABELS),
    _test_sql(_PR, "pr", "pearson", "r", _corr_sql("r", "n"), "n"))))


STATISTICS = {
    "kruskal_h": kruskal_h,
    "kruskal_p": kruskal_p,
    "mann_whitney_u": mann_whitney_u,
    "mann_whitney_p": mann_whitney_p,
    "mann_whitney_years": mann_whitney_years,
    "chi2_stat": chi2_stat,
    "chi2_p": chi2_p,
    "cramers_v": cramers_v,
    "spearman_year": spearman_year,
    "spearman_p": spearman_p,
    "pearson_specialty_year": pearson_specialty_year,
    "pearson_p": pearson_p,
    "trend_line": trend_line,
    "stat_tests": stat_tests,
}
