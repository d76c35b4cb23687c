"""Dashboard document (nested JSON) and the run summary.

Both take one lazy pass over the rows (``plans.summary``): sums by month,
specialty and demographics for the sum-based sections, value counts for the
record-level statistics (quantiles, moments, rank tests). Each section is a
one-row aggregate rendered as JSON text; the document is the ordered
concatenation of the sections in a final aggregation (no joins, nothing
collected to the driver, no job before the caller's). Fractions have a fixed
number of decimals, so the text does not depend on how an engine prints doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import measures as M
from queuelens.functions.constants import DESCRIPTION_KEYS, PATIENT_TYPES, TIME_BANDS
from queuelens.functions.options import Options
from queuelens.operators import distribution as D
from queuelens.operators.model import WaitingList
from queuelens.plans import products as K
from queuelens.plans import sqlkit as S
from queuelens.plans import statistics as T
from queuelens.plans.summary import VALUE, Grain, grains, value_counts

IP, OP = PATIENT_TYPES
DASHBOARD_GRAINS = {
    "months": ["year_month", "year", "patient_type", "time_bands"],
    "specialties": ["specialty_name", "specialty_group", "patient_type", "year", "time_bands"],
    "people": ["patient_type", "year", "case_type", "adult_child", "age_profile", "time_bands"],
    "values": ["patient_type", "year", VALUE],
}
RUN_GRAINS = T.TEST_GRAINS | {"specialties": ["specialty_name", "patient_type", "year", "time_bands"]}


def describe_types(values: Grain) -> DataFrame:
    vt = value_counts(values, "patient_type")
    per_type = vt.select(F.col("patient_type").alias("dataset"), "total", D.CNT)
    allrows = vt.groupBy("total").agg(F.sum(D.CNT).alias(D.CNT)).select(F.lit("Combined").alias("dataset"), "total", D.CNT)
    d = D.describe(per_type.unionByName(allrows), ["dataset"], "total")
    return d.select(*((F.col(c) if digits is None else fixed(c, digits)).alias(k)
                      for k, (c, digits) in zip(DESCRIPTION_KEYS, DESCRIBED)))


# Columns of the description in the order of DESCRIPTION_KEYS, and their decimals.
DESCRIBED = (("dataset", None), ("n", None), ("sum", None), ("mean", 3), ("median", 3), ("mode", None), ("std", 3), ("var", 3),
             ("min", None), ("max", None), ("range", None), ("q1", 3), ("q3", 3), ("iqr", 3), ("p5", 3), ("p95", 3), ("p99", 3),
             ("cv_pct", 2), ("skewness", 3), ("kurtosis", 3), ("outliers", None))
# Results in the section of tests: key, test, column, decimals.
TESTED = (("kw_h", "kruskal_wallis", "statistic", 4), ("kw_p", "kruskal_wallis", "p_value", T.P_DIGITS),
          ("mw_u", "mann_whitney", "statistic", 1), ("mw_p", "mann_whitney", "p_value", T.P_DIGITS),
          ("chi2", "chi_square", "statistic", 2), ("chi2_p", "chi_square", "p_value", T.P_DIGITS),
          ("cramers_v", "cramers_v", "statistic", 4),
          ("sp_r", "spearman", "statistic", 4), ("sp_p", "spearman", "p_value", T.P_DIGITS),
          ("pearson_r", "pearson", "statistic", 4), ("pearson_p", "pearson", "p_value", T.P_DIGITS))


def fixed(c, digits: int) -> Column:
    """Rounded half away from zero, as a decimal that prints all its digits."""
    return M.round_half(M.round_half(c, digits + 1) if c in ("skewness", "kurtosis") else c, digits).cast(f"decimal(30,{digits})")


# sections ---------------------------------------------------------------------------
def _sorted_rows(*fields):
    """Aggregate: the group's rows as an array of structs sorted by the first field."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _pluck(arr, field):
    return F.transform(arr, lambda x: x[field])


def _section(order: int, name: str, body: DataFrame) -> DataFrame:
    """body: one row, one column holding the JSON text of the section."""
    return body.toDF("body").select(F.lit(order).alias("ord"),
                                    F.concat(F.lit(f'"{name}":'), F.col("body")).alias("frag"))


def _field_is(field, value):
    """One-argument predicate for F.filter (a second argument would be the index)."""
    def pred(x):
        return x[field] == F.lit(value)
    return pred


def _by_type(rows, value_field):
    return {t.lower(): _pluck(F.filter(rows, _field_is("patient_type", t)), value_field)
            for t in PATIENT_TYPES}


def sections(g: dict[str, Grain], o: Options) -> list[DataFrame]:
    out = []
    months, specialties, people = g["months"], g["specialties"], g["people"]
    k = K.kpis(specialties, o).withColumn("long_wait_pct", fixed("long_wait_pct", 1))
    out.append(_section(1, "kpis", k.select(F.to_json(F.struct(
        "total_patients", "inpatient_total", "outpatient_total", "long_wait", "long_wait_pct", "specialties")))))

    a = K.annual_pivot(months, o).agg(_sorted_rows("year", "inpatient", "outpatient").alias("r"))
    out.append(_section(2, "annual", a.select(F.to_json(F.struct(
        _pluck("r", "year").alias("years"), _pluck("r", "inpatient").alias("inpatient"),
        _pluck("r", "outpatient").alias("outpatient"))))))

    m = K.monthly_pivot(months, o).agg(_sorted_rows("year_month", "inpatient", "outpatient").alias("r"))
    out.append(_section(3, "monthly", m.select(F.to_json(F.struct(
        _pluck("r", "year_month").alias("labels"), _pluck("r", "inpatient").alias("inpatient"),
        _pluck("r", "outpatient").alias("outpatient"))))))

    b = K.band_pct_by_type(months, o).agg(_sorted_rows("band_order", "patient_type", "total_patients").alias("r"))
    bt = _by_type(F.col("r"), "total_patients")
    out.append(_section(4, "time_bands", b.select(F.to_json(F.struct(
        F.array(*[F.lit(x) for x in TIME_BANDS]).alias("labels"),
        bt["inpatient"].alias("inpatient"), bt["outpatient"].alias("outpatient"))))))

    top = K.top_specialties(specialties, o)
    for order, (name, t) in enumerate((("top_ip", IP), ("top_op", OP)), start=5):
        tt = top.filter(F.col("patient_type") == t).agg(_sorted_rows("rank", "specialty_name", "total_patients").alias("r"))
        out.append(_section(order, name, tt.select(F.to_json(F.struct(
            _pluck("r", "specialty_name").alias("labels"), _pluck("r", "total_patients").alias("values"))))))

    ag = (K.age_by_year(people, o).groupBy("age_profile")
          .agg(_sorted_rows("year", "total_patients").alias("r"))
          .agg(F.array_sort(F.collect_list(F.struct("age_profile", _pluck("r", "total_patients").alias("t"),
                                                    _pluck("r", "year").alias("y")))).alias("a")))
    groups = F.map_from_entries(F.transform("a", lambda x: F.struct(x["age_profile"], x["t"])))
    out.append(_section(7, "age", ag.select(F.to_json(F.struct(
        F.get("a", F.lit(0))["y"].alias("years"), groups.alias("groups"))))))

    ac = K.adult_child_share(people, o).groupBy("patient_type").agg(
        F.map_from_entries(_sorted_rows("adult_child", "total_patients")).alias("m"))
    acj = ac.agg(*[F.first(F.when(F.col("patient_type") == t, F.col("m")), ignorenulls=True).alias(t.lower())
                   for t in PATIENT_TYPES])
    out.append(_section(8, "adult_child", acj.select(F.to_json(F.struct("inpatient", "outpatient")))))

    groups15 = K.group_top15(specialties, o).withColumn("lw_pct", fixed("lw_pct", 1))
    gr = groups15.agg(_sorted_rows(
        (-F.col("total_patients")).alias("k"), "specialty_group", "total_patients", "lw_pct").alias("r"))
    out.append(_section(9, "spec_groups", gr.select(F.to_json(F.struct(
        _pluck("r", "specialty_group").alias("labels"), _pluck("r", "total_patients").alias("totals"),
        _pluck("r", "lw_pct").alias("lw_pct"))))))

    order_ds = F.when(F.col("Dataset") == IP, 0).when(F.col("Dataset") == OP, 1).otherwise(2)
    d = describe_types(g["values"]).withColumn("_o", order_ds)
    dcols = [c for c in d.columns if c != "_o"]
    dj = d.agg(F.array_sort(F.collect_list(F.struct("_o", F.struct(*dcols).alias("row")))).alias("r"))
    out.append(_section(10, "desc_stats", dj.select(F.to_json(_pluck("r", "row")))))

    ts = T.tests_from_grains(g, o)
    picked = [F.format_string(f'"{key}":%.{digits}f', M.round_half(
                  M.round_half(F.max(F.when(F.col("test") == test, F.col(c))), max(6, digits)), digits))
              for key, test, c, digits in TESTED]
    out.append(_section(11, "stat_tests", ts.agg(F.concat(F.lit("{"), F.concat_ws(",", *picked), F.lit("}")))))

    lw = K.long_wait_trend_dense(months, o).agg(_sorted_rows("year_month", "inpatient_long_wait").alias("r"))
    out.append(_section(12, "long_wait_trend", lw.select(F.to_json(F.struct(
        _pluck("r", "year_month").alias("labels"), _pluck("r", "inpatient_long_wait").alias("inpatient"))))))

    ct = K.case_type_pct(people, o).withColumn("pct", fixed("pct", 1)).agg(_sorted_rows("band_order", "case_type", "pct").alias("r"))
    sel = {n: _pluck(F.filter(F.col("r"), _field_is("case_type", v)), "pct")
           for n, v in (("inpatient_pct", "Inpatient"), ("daycase_pct", "Day Case"))}
    out.append(_section(13, "case_type", ct.select(F.to_json(F.struct(
        F.array(*[F.lit(x) for x in TIME_BANDS]).alias("labels"),
        sel["inpatient_pct"].alias("inpatient_pct"), sel["daycase_pct"].alias("daycase_pct"))))))
    return out


def dashboard_document(g: dict[str, Grain], o: Options = Options()) -> DataFrame:
    parts = sections(g, o)
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "frag")))
    return allp.agg(F.concat(F.lit("{"), F.array_join(_pluck(ordered, "frag"), ","), F.lit("}"))
                    .alias("document"))


def dashboard_json(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """K27: the whole dashboard document as one JSON string row."""
    return dashboard_document(grains(wl.combined(), **DASHBOARD_GRAINS), o)


def write_dashboard(doc: DataFrame, path: str) -> None:
    """Write the one-row document as one JSON file at ``path``.

    Spark writes a folder beside it, on any file system it knows; its only
    part is then renamed, so a reader sees the old file or the new one.
    """
    spark = doc.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    doc.coalesce(1).write.mode("overwrite").text(folder.toString())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot rename {part} to {target}")
    fs.delete(folder, True)


def run_summary(wl: WaitingList, o: Options = Options()) -> DataFrame:
    """K28: headline totals, top specialty per type and the key test results, from one pass over the rows."""
    from pyspark.sql import Window as W
    g = grains(wl.combined(), **RUN_GRAINS)
    ss = g["specialties"].frame
    tt = F.col("total")
    tp = F.col("patient_type")
    is_long = M.is_long(band=o.long_band)
    k = ss.agg(F.sum(tt).alias("total"), F.sum(F.when(tp == IP, tt)).alias("inpatient"),
               F.sum(F.when(tp == OP, tt)).alias("outpatient"),
               F.sum(F.when(is_long, tt)).alias("long_wait"))
    per_spec = ss.groupBy("patient_type", "specialty_name").agg(F.sum(tt).alias("t"))
    first = F.row_number().over(W.partitionBy("patient_type").orderBy(F.desc("t"), "specialty_name"))
    top = per_spec.withColumn("_r", first).filter(F.col("_r") == 1)
    ts = T.tests_from_grains(g, o)
    nums = (k.select(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v"))
                               for c in ("total", "inpatient", "outpatient", "long_wait")]).alias("a"))
            .select(F.inline("a"))
            .unionByName(ts.select(F.concat(F.col("test"), F.lit(":stat")).alias("m"), F.col("statistic").alias("v")))
            .unionByName(ts.select(F.concat(F.col("test"), F.lit(":p")).alias("m"), F.col("p_value").alias("v")))
            .withColumn("t", F.lit(None).cast("string")))
    texts = top.select(F.concat(F.lit("top:"), F.col("patient_type")).alias("m"),
                       F.lit(None).cast("double").alias("v"), F.col("specialty_name").alias("t"))
    facts = nums.unionByName(texts)

    def num(name, digits=None):
        v = F.max(F.when(F.col("m") == name, F.col("v")))
        return M.round_half(v, digits) if digits is not None else v

    def txt(name):
        return F.max(F.when(F.col("m") == name, F.col("t")))
    return facts.agg(
        num("total").cast("long").alias("total_patient_waits"), num("inpatient").cast("long").alias("inpatient"),
        num("outpatient").cast("long").alias("outpatient"), num("long_wait").cast("long").alias("long_wait"),
        M.round_half(M.pct(num("long_wait"), num("total")), 1).alias("long_wait_pct"),
        txt(f"top:{IP}").alias("top_inpatient_specialty"), txt(f"top:{OP}").alias("top_outpatient_specialty"),
        num("kruskal_wallis:stat", 1).alias("kw_h"), num("kruskal_wallis:p", T.P_DIGITS).alias("kw_p"),
        num("mann_whitney:p", T.P_DIGITS).alias("mw_p"), num("spearman:stat", 3).alias("sp_r"),
        num("spearman:p", 3).alias("sp_p"), num("cramers_v:stat", 3).alias("cramers_v"))


def _one(ctes: str, value: str, source: str) -> str:
    return f"(WITH {ctes.strip()} SELECT {value} FROM {source})"


def _top_sql(patient_type: str) -> str:
    return (f"(SELECT specialty_name FROM combined WHERE patient_type = '{patient_type}' GROUP BY specialty_name "
            "ORDER BY SUM(total) DESC, specialty_name LIMIT 1)")


_LONG = f"SUM(total) FILTER (WHERE time_bands = '{Options().long_band}')"
SQL = {"run_summary": S.with_adapter(f"""
SELECT {S.big('SUM(total)')} AS total_patient_waits,
       {S.big(f"SUM(total) FILTER (WHERE patient_type = '{IP}')")} AS inpatient,
       {S.big(f"SUM(total) FILTER (WHERE patient_type = '{OP}')")} AS outpatient,
       {S.big(_LONG)} AS long_wait, {S.rnd(S.pct(_LONG, 'SUM(total)'), 1)} AS long_wait_pct,
       {_top_sql(IP)} AS top_inpatient_specialty, {_top_sql(OP)} AS top_outpatient_specialty,
       {_one(T._KW, S.rnd('h', 1), 'kw')} AS kw_h,
       {_one(T._KW, S.rnd(T._chi2_sql('h', 'dof'), T.P_DIGITS), 'kw')} AS kw_p,
       {_one(T._MW, S.rnd(T._normal_sql('z'), T.P_DIGITS), 'mw')} AS mw_p,
       {_one(T._SP, S.rnd('rho', 3), 'sp')} AS sp_r, {_one(T._SP, S.rnd(T._corr_sql('rho', 'n'), 3), 'sp')} AS sp_p,
       {_one(T._CHI, S.rnd('v', 3), 'ch')} AS cramers_v
FROM combined""")}

# The document in SQL: every section from the statement that stands for its plan.
def _array(value: str, order: str, where: str = "TRUE") -> str:
    shown = f"string_agg(coalesce(CAST({value} AS VARCHAR), 'null'), ',' ORDER BY {order}) FILTER (WHERE {where})"
    return f"'[' || coalesce({shown}, '') || ']'"


def _text(name: str) -> str:
    return f"""'"' || {name} || '"'"""


def _decimal(name: str, digits: int) -> str:
    return f"CAST({name} AS DECIMAL(30, {digits}))"


def _object(**fields: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


def _of_type(t: str) -> str:
    return f"patient_type = '{t}'"


_BANDS = "'[" + ",".join(f'"{b}"' for b in TIME_BANDS) + "]'"
_SHOWN = ("dataset", "n", "sum_total", "mean", "median", "mode", "std_dev", "variance", "min_val", "max_val", "range_val",
          "q1", "q3", "iqr", "p5", "p95", "p99", "cv_pct", "skewness", "kurtosis", "outliers")
_DESCRIBED_SQL = {k: _text(c) if c == "dataset" else c if digits is None
                  else _decimal(S.rnd(c, digits), digits)
                  for k, c, (_, digits) in zip(DESCRIPTION_KEYS, _SHOWN, DESCRIBED)}
_TESTED_SQL = {key: f"printf('%.{digits}f', {S.rnd(f'max({c}) FILTER (WHERE test = {test!r})', digits)})"
               for key, test, c, digits in TESTED}
_SECTIONS = (
    ("kpis", K.SQL["kpis"], _object(total_patients="total_patients", inpatient_total="inpatient_total",
                                    outpatient_total="outpatient_total", long_wait="long_wait",
                                    long_wait_pct=_decimal("long_wait_pct", 1), specialties="specialties")),
    ("annual", K.SQL["annual_pivot"], _object(years=_array("year", "year"), inpatient=_array("inpatient", "year"),
                                              outpatient=_array("outpatient", "year"))),
    ("monthly", K.SQL["monthly_pivot"], _object(
        labels=_array(_text("year_month"), "year_month"), inpatient=_array("inpatient", "year_month"),
        outpatient=_array("outpatient", "year_month"))),
    ("time_bands", K.SQL["band_pct_by_type"], _object(labels=_BANDS, **{
        t.lower(): _array("total_patients", "band_order", _of_type(t)) for t in PATIENT_TYPES})),
    *((name, K.SQL["top_specialties"], _object(labels=_array(_text("specialty_name"), "rank", _of_type(t)),
                                               values=_array("total_patients", "rank", _of_type(t))))
      for name, t in (("top_ip", IP), ("top_op", OP))),
    ("age", f"""SELECT age_profile, {_array("year", "year")} AS years, {_array("total_patients", "year")} AS totals
                FROM ({K.SQL["age_by_year"]}) GROUP BY age_profile""",
     _object(years="min(years)", groups=f"""'{{' || string_agg({_text("age_profile")} || ':' || totals, ',' ORDER BY age_profile) || '}}'""")),
    ("adult_child", K.SQL["adult_child_share"], _object(**{
        t.lower(): f"""'{{' || string_agg({_text("adult_child")} || ':' || total_patients, ',' ORDER BY adult_child)
                       FILTER (WHERE {_of_type(t)}) || '}}'""" for t in PATIENT_TYPES})),
    ("spec_groups", K.SQL["group_top15"], _object(
        labels=_array(_text("specialty_group"), "total_patients DESC, specialty_group"),
        totals=_array("total_patients", "total_patients DESC, specialty_group"),
        lw_pct=_array(_decimal("lw_pct", 1), "total_patients DESC, specialty_group"))),
    ("desc_stats", K.SQL["descriptive_table"], _array(
        _object(**{k.replace(" ", "~"): v for k, v in _DESCRIBED_SQL.items()}).replace("~", " "),
        f"CASE dataset WHEN '{IP}' THEN 0 WHEN '{OP}' THEN 1 ELSE 2 END")),
    ("stat_tests", T.SQL["stat_tests"], _object(**_TESTED_SQL)),
    ("long_wait_trend", K.SQL["long_wait_trend_dense"], _object(
        labels=_array(_text("year_month"), "year_month"), inpatient=_array("inpatient_long_wait", "year_month"))),
    ("case_type", K.SQL["case_type_pct"], _object(labels=_BANDS, **{
        name: _array(_decimal("pct", 1), "band_order", f"case_type = '{t}'")
        for name, t in (("inpatient_pct", "Inpatient"), ("daycase_pct", "Day Case"))})),
)
SQL["dashboard_json"] = ("SELECT '{' || " + " || ',' || ".join(
    f"""'"{name}":' || (SELECT {shown} FROM ({body}))""" for name, body, shown in _SECTIONS) + " || '}' AS document")

EXPORTS = {
    "dashboard_json": dashboard_json,
    "run_summary": run_summary,
}
