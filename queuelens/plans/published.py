"""Measures published as results without code behind them, and the
primitive-level checks (data quality, cleaning rules, formatting)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from queuelens.functions import measures as M
from queuelens.functions.constants import ELDERLY_AGE, PATIENT_TYPES
from queuelens.functions.options import Options
from queuelens.operators import distribution as D
from queuelens.operators.distincts import bitmaps, rolled_up
from queuelens.operators.model import WaitingList, drop_null_age, waiting_list
from queuelens.operators.quantiles import wide_percentiles
from queuelens.operators.ranktests import spearman
from queuelens.plans import sqlkit as S
from queuelens.plans.products import _corr_sql, _fmt_sql, corr_long
from queuelens.plans.statistics import spec_year
from queuelens.sources.csv_ingest import normalise_band

SQL: dict[str, str] = {}
IP, OP = PATIENT_TYPES


# L1 -------------------------------------------------------------------------
def type_share(wl: WaitingList, o: Options = Options()) -> DataFrame:
    t = wl.view(o.drop_null_age).groupBy("patient_type").agg(F.sum("total").alias("total_patients"))
    return t.withColumn("share_pct", M.round_half(
        M.pct("total_patients", F.sum("total_patients").over(W.partitionBy())), 1)).orderBy("patient_type")


SQL["type_share"] = S.with_adapter(f"""
SELECT patient_type, CAST(SUM(total) AS BIGINT) AS total_patients,
       {S.rnd(S.pct('SUM(total)', 'SUM(SUM(total)) OVER ()'), 1)} AS share_pct
FROM vw_waiting_list_full GROUP BY patient_type""")


# L2 -------------------------------------------------------------------------
def long_wait_month_growth(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Inpatient long waits per month against the same month a year earlier,
    on a dense calendar axis (months without rows count as 0).

    One aggregation per present month, folded into a single row holding the
    month -> total map and the first/last month (bounded by the number of
    months); the calendar axis is a month ``sequence`` exploded from it.
    """
    ip = wl.view(o.drop_null_age).filter(F.col("patient_type") == IP)
    per_month = ip.groupBy(F.trunc(F.col("archive_date"), "month").alias("m")).agg(
        M.sum_when(M.is_long(band=o.long_band)).alias("_lw"))
    span = per_month.agg(F.map_from_entries(F.collect_list(F.struct("m", "_lw"))).alias("_map"),
                         F.min("m").alias("lo"), F.max("m").alias("hi"))
    axis = span.select("_map", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    dense = axis.select(F.date_format("m", "yyyy-MM").alias("year_month"),
                        F.coalesce(F.col("_map")[F.col("m")], F.lit(0)).cast("long").alias("long_wait"))
    prev = F.lag("long_wait", 12).over(W.orderBy("year_month"))
    return (dense.select("year_month", "long_wait", prev.alias("long_wait_prev_year"),
                         M.round_half(M.pct(F.col("long_wait") - prev, prev), 1).alias("growth_pct"))
            .orderBy("year_month"))


SQL["long_wait_month_growth"] = S.with_adapter(f"""
SELECT year_month, long_wait, LAG(long_wait, 12) OVER (ORDER BY year_month) AS long_wait_prev_year,
       {S.rnd(S.pct('long_wait - LAG(long_wait, 12) OVER (ORDER BY year_month)', 'LAG(long_wait, 12) OVER (ORDER BY year_month)'), 1)} AS growth_pct
FROM (SELECT strftime(m, '%Y-%m') AS year_month, CAST(COALESCE(l.s, 0) AS BIGINT) AS long_wait
      FROM (SELECT unnest(generate_series(date_trunc('month', MIN(archive_date)), date_trunc('month', MAX(archive_date)), INTERVAL 1 MONTH)) AS m
            FROM vw_waiting_list_full WHERE patient_type = 'Inpatient') ax
      LEFT JOIN (SELECT year_month, SUM(total) AS s FROM vw_waiting_list_full
                 WHERE patient_type = 'Inpatient' AND time_bands = '18+ Months' GROUP BY year_month) l
        ON l.year_month = strftime(ax.m, '%Y-%m'))""")


# L3 -------------------------------------------------------------------------
def age_cohort_growth(wl: WaitingList, o: Options = Options()) -> DataFrame:
    a, b = o.early_year, o.compare_year
    old = F.col("age_profile") == ELDERLY_AGE
    g = (wl.view(o.drop_null_age).groupBy("patient_type")
         .agg(M.sum_when(old & (F.col("year") == a)).alias(f"elderly_{a}"),
              M.sum_when(old & (F.col("year") == b)).alias(f"elderly_{b}")))
    return g.withColumn("growth_pct", M.round_half(
        M.pct(F.col(f"elderly_{b}") - F.col(f"elderly_{a}"), f"elderly_{a}"), 1)).orderBy("patient_type")


def _cohort_sql(o: Options = Options()) -> str:
    a, b = o.early_year, o.compare_year
    ea = f"SUM(CASE WHEN age_profile = '65+' AND year = {a} THEN total ELSE 0 END)"
    eb = f"SUM(CASE WHEN age_profile = '65+' AND year = {b} THEN total ELSE 0 END)"
    return S.with_adapter(f"""
SELECT patient_type, CAST({ea} AS BIGINT) AS elderly_{a}, CAST({eb} AS BIGINT) AS elderly_{b},
       {S.rnd(S.pct(f'{eb} - {ea}', ea), 1)} AS growth_pct
FROM vw_waiting_list_full GROUP BY patient_type""")


SQL["age_cohort_growth"] = _cohort_sql()


# L4 -------------------------------------------------------------------------
def spearman_specialty_year(wl: WaitingList, o: Options = Options()) -> DataFrame:
    s = spearman(spec_year(wl.combined()), "year", "AvgWait")
    return s.select(M.round_half("rho", 6).alias("rho"), "n")


SQL["spearman_specialty_year"] = S.with_adapter(f"""
SELECT {S.rnd('corr(rx, ry)', 6)} AS rho, COUNT(*) AS n FROM (
  SELECT RANK() OVER (ORDER BY year) + (COUNT(*) OVER (PARTITION BY year) - 1) / 2.0 AS rx,
         RANK() OVER (ORDER BY AvgWait) + (COUNT(*) OVER (PARTITION BY AvgWait) - 1) / 2.0 AS ry
  FROM (SELECT specialty_name, year, AVG(wait_rank) AS AvgWait FROM combined
        GROUP BY specialty_name, year HAVING AVG(wait_rank) IS NOT NULL))""")


# L5 -------------------------------------------------------------------------
def corr_with_records(wl: WaitingList, o: Options = Options()) -> DataFrame:
    sy = spec_year(wl.combined()).select(F.col("year").alias("Year"), "Total", "Records", "AvgWait")
    return corr_long(sy, ["Year", "Total", "Records", "AvgWait"])


SQL["corr_with_records"] = _corr_sql(["Year", "Total", "Records", "AvgWait"])


# primitive checks -------------------------------------------------------------
def waiting_list_full(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """The canonical view summarised by every category it carries."""
    keys = ["patient_type", "specialty_group", "case_type", "adult_child", "age_profile",
            "time_bands", "wait_rank", "band_rank", "year", "month"]
    return (wl.view(o.drop_null_age).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("records"), F.sum("total").alias("total_patients")))


SQL["waiting_list_full"] = S.with_adapter(f"""
SELECT patient_type, specialty_group, case_type, adult_child, age_profile, time_bands, wait_rank,
       {S.band_order()} AS band_rank, year, month, COUNT(*) AS records, CAST(SUM(total) AS BIGINT) AS total_patients
FROM vw_waiting_list_full GROUP BY ALL""")


def _messy_band():
    """Band text made messy from the data itself: padding, tabs, old spelling."""
    t, m = F.col("total"), F.col("month")
    variant = F.when((F.col("time_bands") == "18+ Months") & (t % 2 == 0), F.lit("18 Months +")) \
               .otherwise(F.col("time_bands"))
    return F.concat(F.repeat(F.lit(" "), t % 3), variant,
                    F.when(m % 4 == 0, F.lit("\t")).otherwise(F.lit("")))


def band_normalised(wl: WaitingList, o: Options = Options()) -> DataFrame:
    raw = wl.view(o.drop_null_age).filter(F.col("time_bands").isNotNull()).withColumn("raw_band", _messy_band())
    return (raw.groupBy(normalise_band(F.col("raw_band")).alias("time_bands"))
            .agg(F.count_distinct("raw_band").alias("raw_variants"),
                 F.count(F.lit(1)).alias("records"), F.sum("total").alias("total_patients")))


SQL["band_normalised"] = S.with_adapter(r"""
SELECT CASE WHEN s = '18 Months +' THEN '18+ Months' ELSE s END AS time_bands,
       COUNT(DISTINCT raw_band) AS raw_variants, COUNT(*) AS records, CAST(SUM(total) AS BIGINT) AS total_patients
FROM (SELECT raw_band, total, regexp_replace(regexp_replace(raw_band, '^\s+', ''), '\s+$', '') AS s
      FROM (SELECT total, repeat(' ', CAST(total % 3 AS INTEGER))
                   || CASE WHEN time_bands = '18+ Months' AND total % 2 = 0 THEN '18 Months +' ELSE time_bands END
                   || CASE WHEN month % 4 = 0 THEN chr(9) ELSE '' END AS raw_band
            FROM vw_waiting_list_full WHERE time_bands IS NOT NULL))
GROUP BY 1""")


def outpatient_with_age(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Outpatient rows under both settings of the null-age rule."""
    op = wl.full().filter(F.col("patient_type") == OP)
    no_age = F.col("age_profile").isNull()
    agg = op.agg(F.count(F.lit(1)).alias("_n"), F.sum("total").alias("_t"),
                 F.count_if(no_age).alias("_nn"), M.sum_when(no_age).alias("_tn"))
    rows = F.array(
        F.struct(F.lit(False).alias("drop_null_age"), F.col("_n").alias("records"),
                 F.col("_t").alias("total_patients"), F.col("_nn").alias("null_age_records")),
        F.struct(F.lit(True).alias("drop_null_age"), (F.col("_n") - F.col("_nn")).alias("records"),
                 (F.col("_t") - F.col("_tn")).alias("total_patients"), F.lit(0).cast("long").alias("null_age_records")))
    return agg.select(F.inline(rows))


SQL["outpatient_with_age"] = S.with_adapter("""
SELECT false AS drop_null_age, COUNT(*) AS records, CAST(SUM(total) AS BIGINT) AS total_patients,
       COUNT(*) FILTER (WHERE age_profile IS NULL) AS null_age_records
FROM vw_waiting_list_full WHERE patient_type = 'Outpatient'
UNION ALL
SELECT true, COUNT(*), CAST(SUM(total) AS BIGINT), CAST(0 AS BIGINT)
FROM combined WHERE patient_type = 'Outpatient'""")


_AUDIT_COLS = {
    "Inpatient": ["archive_date", "specialty_hipe", "specialty_name", "case_type", "adult_child",
                  "age_profile", "time_bands", "total", "year", "specialty_group", "wait_rank"],
    "Outpatient": ["archive_date", "specialty_hipe", "specialty_name", "adult_child",
                   "age_profile", "time_bands", "total", "year", "specialty_group", "wait_rank"],
    "Combined": ["archive_date", "year", "month", "year_month", "specialty_name", "specialty_group",
                 "adult_child", "age_profile", "time_bands", "total", "patient_type", "wait_rank"],
}


def null_audit(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Nulls per column per dataset (only counts above zero), in one pass."""
    c = wl.combined()
    tp = F.col("patient_type")
    scope = {"Inpatient": tp == IP, "Outpatient": tp == OP, "Combined": F.lit(True)}
    aggs, names = [], []
    for ds, cols in _AUDIT_COLS.items():
        for col in cols:
            aggs.append(F.count_if(scope[ds] & F.col(col).isNull()).alias(f"{ds}|{col}"))
            names.append(f"{ds}|{col}")
    wide = c.agg(*aggs)
    long = wide.unpivot([], names, "key", "null_count")
    return (long.filter(F.col("null_count") > 0)
            .select(F.split("key", r"\|")[0].alias("dataset"), F.split("key", r"\|")[1].alias("column_name"),
                    "null_count"))


def _null_audit_body() -> str:
    parts = []
    for ds, cols in _AUDIT_COLS.items():
        cond = "TRUE" if ds == "Combined" else f"patient_type = '{ds}'"
        for col in cols:
            parts.append(f"SELECT '{ds}' AS dataset, '{col}' AS column_name, "
                         f"COUNT(*) FILTER (WHERE {cond} AND {col} IS NULL) AS null_count FROM combined")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE null_count > 0"


SQL["null_audit"] = S.with_adapter(_null_audit_body())


def load_summary(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Rows, total, date range and distinct specialties / groups per dataset.

    The rows are first reduced to one row per (type, specialty, group); the
    distinct counts then run on that small table instead of expanding every
    row once per distinct expression.
    """
    per = (wl.combined().groupBy("patient_type", "specialty_name", "specialty_group")
           .agg(F.count(F.lit(1)).alias("_n"), F.sum("total").alias("_t"),
                F.min("archive_date").alias("_lo"), F.max("archive_date").alias("_hi")))
    tp = F.col("patient_type")
    scopes = [("Inpatient", tp == IP), ("Outpatient", tp == OP), ("Combined", F.lit(True))]
    aggs = []
    for i, (_, cond) in enumerate(scopes):
        aggs += [F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0))).alias(f"n{i}"),
                 F.sum(F.when(cond, F.col("_t")).otherwise(F.lit(0))).alias(f"t{i}"),
                 F.min(F.when(cond, F.col("_lo"))).alias(f"lo{i}"),
                 F.max(F.when(cond, F.col("_hi"))).alias(f"hi{i}"),
                 F.count_distinct(F.when(cond, F.col("specialty_name"))).alias(f"s{i}"),
                 F.count_distinct(F.when(cond, F.col("specialty_group"))).alias(f"g{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("dataset"), F.col(f"n{i}").alias("records"),
                              F.col(f"t{i}").alias("total_patients"), F.col(f"lo{i}").alias("first_date"),
                              F.col(f"hi{i}").alias("last_date"), F.col(f"s{i}").alias("specialties"),
                              F.col(f"g{i}").alias("specialty_groups"))
                     for i, (name, _) in enumerate(scopes)])
    return per.agg(*aggs).select(F.inline(rows))


_LOAD_SUMMARY_BODY = """
SELECT patient_type AS dataset, COUNT(*) AS records, CAST(SUM(total) AS BIGINT) AS total_patients,
       MIN(archive_date) AS first_date, MAX(archive_date) AS last_date,
       COUNT(DISTINCT specialty_name) AS specialties, COUNT(DISTINCT specialty_group) AS specialty_groups
FROM combined GROUP BY patient_type
UNION ALL
SELECT 'Combined', COUNT(*), CAST(SUM(total) AS BIGINT), MIN(archive_date), MAX(archive_date),
       COUNT(DISTINCT specialty_name), COUNT(DISTINCT specialty_group) FROM combined"""
SQL["load_summary"] = S.with_adapter(_LOAD_SUMMARY_BODY)


def load_audit(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Load summary and null audit together, long form (dataset, metric, value),
    from one pass: rows are reduced to (type, specialty, group) with their
    counts, date range and per-column null counts, and one aggregation of
    that small table yields every metric."""
    key_cols = {"patient_type", "specialty_name", "specialty_group"}
    audited = sorted({c for cols in _AUDIT_COLS.values() for c in cols} - key_cols)
    per = (wl.combined().groupBy("patient_type", "specialty_name", "specialty_group")
           .agg(F.count(F.lit(1)).alias("_n"), F.sum("total").alias("_t"),
                F.min("archive_date").alias("_lo"), F.max("archive_date").alias("_hi"),
                *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in audited]))
    tp = F.col("patient_type")
    scopes = {"Inpatient": tp == IP, "Outpatient": tp == OP, "Combined": F.lit(True)}

    def nulls(col, cond):
        if col in key_cols:
            return F.sum(F.when(cond & F.col(col).isNull(), F.col("_n")).otherwise(F.lit(0)))
        return F.sum(F.when(cond, F.col(f"_null_{col}")).otherwise(F.lit(0)))
    aggs, entries = [], []
    for ds, cond in scopes.items():
        metrics = {
            "records": F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0))),
            "total_patients": F.sum(F.when(cond, F.col("_t")).otherwise(F.lit(0))),
            "first_date": F.min(F.when(cond, F.col("_lo"))),
            "last_date": F.max(F.when(cond, F.col("_hi"))),
            "specialties": F.count_distinct(F.when(cond, F.col("specialty_name"))),
            "specialty_groups": F.count_distinct(F.when(cond, F.col("specialty_group"))),
        }
        for m, e in metrics.items():
            aggs.append(e.cast("string").alias(f"{ds}|{m}"))
            entries.append((ds, m, f"{ds}|{m}", None))
        for col in _AUDIT_COLS[ds]:
            aggs.append(nulls(col, cond).alias(f"{ds}|null|{col}"))
            entries.append((ds, f"nulls:{col}", f"{ds}|null|{col}", True))
    wide = per.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(ds).alias("dataset"), F.lit(m).alias("metric"),
                              F.col(f"`{c}`").cast("string").alias("value"),
                              (F.col(f"`{c}`") > 0 if is_null else F.lit(True)).alias("_keep"))
                     for ds, m, c, is_null in entries])
    return wide.select(F.inline(rows)).filter("_keep").drop("_keep")


def distinct_rollup(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Distinct specialties per type and year, per type, per year and overall, all from one set of bitmaps."""
    maps = bitmaps(wl.combined(), ["patient_type", "year"], "specialty_name")
    return rolled_up(maps, [["patient_type", "year"], ["patient_type"], ["year"], []], "specialties")


SQL["distinct_rollup"] = S.with_adapter("""
SELECT patient_type, year, GROUPING(patient_type, year) AS grain, COUNT(DISTINCT specialty_name) AS specialties
FROM combined GROUP BY GROUPING SETS ((patient_type, year), (patient_type), (year), ())""")


_AUDIT_METRICS = ["records", "total_patients", "first_date", "last_date", "specialties", "specialty_groups"]
SQL["load_audit"] = S.with_adapter("\nUNION ALL\n".join(
    [f"SELECT dataset, '{m}' AS metric, CAST({m} AS VARCHAR) AS value FROM ls" for m in _AUDIT_METRICS]
    + ["SELECT dataset, 'nulls:' || column_name AS metric, CAST(null_count AS VARCHAR) AS value FROM na"]),
    ctes=f"ls AS ({_LOAD_SUMMARY_BODY}),\nna AS ({_null_audit_body()})")


def pk_duplicates(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Dimension keys that occur more than once (they would multiply fact rows)."""
    return (wl.dim.groupBy("specialty_name").agg(F.count(F.lit(1)).alias("occurrences"))
            .filter(F.col("occurrences") > 1))


SQL["pk_duplicates"] = S.with_adapter("""
SELECT specialty_name, COUNT(*) AS occurrences FROM dim_specialty GROUP BY specialty_name HAVING COUNT(*) > 1""")


def fk_orphans(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Fact specialties without a dimension row (they fall back to 'Other')."""
    facts = waiting_list(wl.inpatient, wl.outpatient)
    if o.drop_null_age:
        facts = drop_null_age(facts)
    per = facts.groupBy("patient_type", "specialty_name").agg(
        F.count(F.lit(1)).alias("records"), F.sum("total").alias("total_patients"))
    return per.join(wl.dim.select("specialty_name"), "specialty_name", "left_anti").select(
        "patient_type", "specialty_name", "records", "total_patients")


SQL["fk_orphans"] = S.with_adapter("""
SELECT patient_type, specialty_name, COUNT(*) AS records, CAST(SUM(total) AS BIGINT) AS total_patients
FROM vw_waiting_list w WHERE NOT EXISTS (SELECT 1 FROM dim_specialty d WHERE d.specialty_name = w.specialty_name)
GROUP BY patient_type, specialty_name""")


def hipe_missing(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Rows without a specialty code are kept and flagged; code-level counts skip them."""
    missing = F.col("specialty_hipe").isNull()
    return (wl.view(o.drop_null_age).groupBy("patient_type")
            .agg(F.count_if(missing).alias("missing_code_records"),
                 M.sum_when(missing).alias("missing_code_total"),
                 F.count_if(~missing).alias("coded_records"),
                 F.count_distinct("specialty_hipe").alias("distinct_codes")))


SQL["hipe_missing"] = S.with_adapter("""
SELECT patient_type, COUNT(*) FILTER (WHERE specialty_hipe IS NULL) AS missing_code_records,
       CAST(SUM(CASE WHEN specialty_hipe IS NULL THEN total ELSE 0 END) AS BIGINT) AS missing_code_total,
       COUNT(*) FILTER (WHERE specialty_hipe IS NOT NULL) AS coded_records,
       COUNT(DISTINCT specialty_hipe) AS distinct_codes
FROM vw_waiting_list_full GROUP BY patient_type""")


def winsorised_total(wl: WaitingList, o: Options = Options()) -> DataFrame:
    vc = D.value_counts(wl.combined(), ["patient_type"], "total")
    clip = F.percentile("total", F.lit(float(o.winsor_quantile)), F.col(D.CNT)).over(W.partitionBy("patient_type"))
    v = vc.select("*", clip.alias("clip_at"))
    clipped = F.least(F.col("total").cast("double"), F.col("clip_at"))
    return (v.groupBy("patient_type")
            .agg(F.first("clip_at").alias("clip_at"),
                 F.sum(F.when(F.col("total") > F.col("clip_at"), F.col(D.CNT)).otherwise(0)).alias("clipped_records"),
                 F.sum(clipped * F.col(D.CNT)).alias("_s"), F.sum(D.CNT).alias("_n"))
            .select("patient_type", M.round_half("clip_at", 4).alias("clip_at"), "clipped_records",
                    M.round_half("_s", 4).alias("winsorised_sum"),
                    M.round_half(F.col("_s") / F.col("_n"), 4).alias("winsorised_mean")))


SQL["winsorised_total"] = S.with_adapter(f"""
SELECT c.patient_type, {S.rnd('p.clip_at', 4)} AS clip_at,
       COUNT(*) FILTER (WHERE c.total > p.clip_at) AS clipped_records,
       {S.rnd('SUM(least(CAST(c.total AS DOUBLE), p.clip_at))', 4)} AS winsorised_sum,
       {S.rnd('AVG(least(CAST(c.total AS DOUBLE), p.clip_at))', 4)} AS winsorised_mean
FROM combined c JOIN (SELECT patient_type, quantile_cont(total, 0.98) AS clip_at FROM combined GROUP BY 1) p
  ON c.patient_type = p.patient_type
GROUP BY c.patient_type, p.clip_at""")


MONTHLY_PROBS = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}


def monthly_total_percentiles(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """Spread of the specialties' monthly totals per type. Sums hardly repeat, so that their distinct values
    are as many as the rows: the percentiles come from ranges of them."""
    sums = wl.view(o.drop_null_age).groupBy("patient_type", "specialty_name", "year_month").agg(F.sum("total").alias("monthly"))
    found = wide_percentiles(D.value_counts(sums, ["patient_type"], "monthly"), ["patient_type"], "monthly",
                             list(MONTHLY_PROBS.values()))
    return found.select("patient_type", *(M.round_half(f"p{i}", 4).alias(name) for i, name in enumerate(MONTHLY_PROBS)))


SQL["monthly_total_percentiles"] = S.with_adapter(
    "SELECT patient_type, " + ", ".join(f"{S.rnd(f'quantile_cont(monthly, {p})', 4)} AS {name}" for name, p in MONTHLY_PROBS.items())
    + " FROM sums GROUP BY patient_type",
    ctes="""sums AS (SELECT patient_type, specialty_name, year_month, CAST(SUM(total) AS DOUBLE) AS monthly
FROM vw_waiting_list_full GROUP BY patient_type, specialty_name, year_month)""")


def human_format(wl: WaitingList, o: Options = Options()) -> DataFrame:
    t = wl.combined().groupBy("patient_type", "specialty_name").agg(F.sum("total").alias("total_patients"))
    return t.withColumn("label", M.human_format("total_patients"))


SQL["human_format"] = S.with_adapter(f"""
SELECT patient_type, specialty_name, CAST(SUM(total) AS BIGINT) AS total_patients,
       {_fmt_sql('CAST(SUM(total) AS DOUBLE)')} AS label
FROM combined GROUP BY patient_type, specialty_name""")


PUBLISHED = {
    "type_share": type_share,
    "long_wait_month_growth": long_wait_month_growth,
    "age_cohort_growth": age_cohort_growth,
    "spearman_specialty_year": spearman_specialty_year,
    "corr_with_records": corr_with_records,
    "waiting_list_full": waiting_list_full,
    "band_normalised": band_normalised,
    "outpatient_with_age": outpatient_with_age,
    "null_audit": null_audit,
    "load_summary": load_summary,
    "distinct_rollup": distinct_rollup,
    "load_audit": load_audit,
    "pk_duplicates": pk_duplicates,
    "fk_orphans": fk_orphans,
    "hipe_missing": hipe_missing,
    "winsorised_total": winsorised_total,
    "monthly_total_percentiles": monthly_total_percentiles,
    "human_format": human_format,
}
