"""Hand-made frames for the rules the reports depend on."""

from pyspark.sql import functions as F

from queuelens.functions import measures as M
from queuelens.functions.options import Options
from queuelens.operators.model import WaitingList
from queuelens.plans import products, reports

IP_SCHEMA = ("archive_date date, specialty_hipe int, specialty_name string, case_type string, "
             "adult_child string, age_profile string, time_bands string, total int, year int")
OP_SCHEMA = ("archive_date date, specialty_hipe int, specialty_name string, adult_child string, "
             "age_profile string, time_bands string, total int, year int")


def _wl(spark, ip_rows, op_rows, dim_rows=(("A", "G1"),)):
    import datetime as dt
    ip = spark.createDataFrame([(dt.date(r[0], r[1], 1), 1, r[2], "Inpatient", "Adult", "16-64", r[3], r[4], r[0])
                                for r in ip_rows], IP_SCHEMA)
    op = spark.createDataFrame([(dt.date(r[0], r[1], 1), 1, r[2], "Adult", r[5] if len(r) > 5 else "65+", r[3], r[4], r[0])
                                for r in op_rows], OP_SCHEMA)
    dim = spark.createDataFrame(list(dim_rows), "specialty_name string, specialty_group string")
    return WaitingList(ip, op, dim)


def test_yoy_needs_exact_previous_year(spark):
    wl = _wl(spark, [(1998, 1, "A", "0-3 Months", 10), (2000, 1, "A", "0-3 Months", 30),
                     (2001, 1, "A", "0-3 Months", 0)], [])
    rows = reports.yoy_change(wl).collect()
    assert [(r["year"], r["pct_change"]) for r in rows] == [(2001, -100.0)]
    lagged = products.yoy_pct_change(wl).collect()          # previous present year
    assert [(r["year"], r["prior_total"]) for r in lagged] == [(2000, 10), (2001, 30)]


def test_zero_base_gives_null_not_error(spark):
    wl = _wl(spark, [(1999, 1, "A", "0-3 Months", 0), (2000, 1, "A", "0-3 Months", 5)], [])
    r = reports.yoy_change(wl).collect()[0]
    assert r["pct_change"] is None


def test_threshold_edges_unrounded_vs_rounded(spark):
    df = spark.createDataFrame([(4.0,), (7.0,), (6.999,), (10.04,), (5.04,)], "p double")
    risk = [r[0] for r in df.select(M.classify_at_least("p", (7.0, 4.0), ("HIGH", "MEDIUM", "LOW"))).collect()]
    assert risk == ["MEDIUM", "HIGH", "MEDIUM", "HIGH", "MEDIUM"]
    flag = [r[0] for r in df.select(M.classify_above(M.round_half("p", 1), (10.0, 5.0), ("S", "E", "n"))).collect()]
    assert flag == ["n", "E", "E", "E", "n"]   # 10.04 rounds to 10.0: not above 10


def test_unmatched_specialty_defaults_to_other_and_null_age_rule(spark):
    wl = _wl(spark, [(1999, 1, "A", "0-3 Months", 1), (1999, 1, "ZZ", "18+ Months", 2)],
             [(1999, 1, "A", "3-6 Months", 4, None), (1999, 2, "A", "3-6 Months", 8)])
    groups = {r["specialty_name"]: r["specialty_group"] for r in wl.full().collect()}
    assert groups == {"A": "G1", "ZZ": "Other"}
    assert wl.full().count() == 4 and wl.combined().count() == 3
    keep = reports.annual_totals(wl, Options(drop_null_age=False)).collect()
    drop = reports.annual_totals(wl, Options(drop_null_age=True)).collect()
    assert sum(r["total_patients"] for r in keep) == 15 and sum(r["total_patients"] for r in drop) == 11


def test_densify_missing_bands_and_pivot_sums(spark):
    wl = _wl(spark, [(1999, 1, "A", "0-3 Months", 3)], [(1999, 1, "A", "18+ Months", 9)])
    b = products.band_pct_by_type(wl).collect()
    assert len(b) == 14 and sum(r["total_patients"] for r in b) == 12
    shares = {}
    for r in b:
        shares[r["patient_type"]] = shares.get(r["patient_type"], 0) + r["pct_of_type"]
    assert all(abs(v - 100.0) < 1e-9 for v in shares.values())
    piv = products.annual_pivot(wl).collect()[0]
    assert piv["inpatient"] + piv["outpatient"] == 12


def test_centered_average_null_at_edges(spark):
    wl = _wl(spark, [(1999, m, "A", "0-3 Months", m) for m in (1, 2, 3, 4)], [])
    rows = products.inpatient_centered_avg(wl).orderBy("year_month").collect()
    assert [r["centered_avg"] for r in rows] == [None, 2.0, 3.0, None]


def test_month_growth_uses_dense_axis(spark):
    from queuelens.plans import published
    ip = [(1999, 1, "A", "18+ Months", 10), (2000, 1, "A", "18+ Months", 25), (2000, 3, "A", "0-3 Months", 1)]
    wl = _wl(spark, ip, [])
    rows = {r["year_month"]: r for r in published.long_wait_month_growth(wl).collect()}
    assert len(rows) == 15 and rows["2000-01"]["growth_pct"] == 150.0
    assert rows["1999-02"]["long_wait"] == 0


def test_monthly_rolling_equals_running_backlog(spark):
    wl = _wl(spark, [(1999, m, "A", "0-3 Months", m * 3) for m in range(1, 8)],
             [(1999, m, "A", "3-6 Months", m) for m in range(1, 8)])
    a = {(r["year_month"], r["patient_type"]): (r["monthly_total"], r["cumulative_total"])
         for r in reports.monthly_rolling(wl).collect()}
    b = {(r["year_month"], r["patient_type"]): (r["monthly_total"], r["cumulative_total"])
         for r in reports.running_backlog(wl).collect()}
    assert a == b


def test_human_format(spark):
    df = spark.createDataFrame([(None,), (999.0,), (1499.0,), (34200.0,), (1250000.0,)], "x double")
    got = [r[0] for r in df.select(M.human_format("x")).collect()]
    assert got == ["", "999", "1K", "34K", "1.3M"]


def test_top_k_tie_break_by_name(spark):
    ip = [(1999, 1, n, "0-3 Months", 5) for n in ("C", "A", "B")]
    wl = _wl(spark, ip, [], dim_rows=[("A", "G"), ("B", "G"), ("C", "G")])
    top = products._top_per_type(wl.combined(), 2).orderBy("rank").collect()
    assert [r["specialty_name"] for r in top] == ["A", "B"]


def test_no_cartesian_product_in_plans(spark):
    from queuelens.plans.registry import all_plans as queries
    for name, fn in queries().items():
        if name in ("dashboard_json", "run_summary"):
            continue
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_sql_views_match_dataframe_plan(spark):
    from queuelens.operators.model import register_views
    from queuelens.plans.registry import waiting_list_from_testdata
    wl = waiting_list_from_testdata(spark, "/root/testdata/sf0.001")
    register_views(wl, prefix="ql_")
    via_sql = spark.sql("""SELECT year, patient_type, SUM(total) AS total_patients, COUNT(*) AS record_count
                           FROM ql_vw_waiting_list_full GROUP BY year, patient_type""")
    assert sorted(map(tuple, via_sql.collect())) == sorted(map(tuple, reports.annual_totals(wl).collect()))


def test_even_count_median_equals_middle_pair(spark):
    wl = _wl(spark, [(1999, 1, "A", "0-3 Months", v) for v in (1, 2, 10, 40)],
             [(1999, 1, "A", "3-6 Months", v) for v in (5, 7, 9)])
    rows = {r["patient_type"]: r["median_total"] for r in reports.type_stats_median(wl).collect()}
    assert rows == {"Inpatient": 6.0, "Outpatient": 7.0}


def test_null_keys_sql_keeps_pandas_drops(spark):
    import datetime as dt
    ip = spark.createDataFrame([(dt.date(1999, 1, 1), 1, "A", "Inpatient", None, None, None, 4, 1999),
                                (dt.date(1999, 1, 1), 1, "A", "Inpatient", "Adult", "65+", "0-3 Months", 6, 1999)],
                               IP_SCHEMA)
    op = spark.createDataFrame([], OP_SCHEMA)
    dim = spark.createDataFrame([("A", "G")], "specialty_name string, specialty_group string")
    wl = WaitingList(ip, op, dim)
    bands = {r["time_bands"]: r["total_patients"] for r in reports.band_profile(wl).collect()}
    assert bands == {None: 4, "0-3 Months": 6}                     # SQL GROUP BY keeps the null group
    shares = {r["adult_child"] for r in products.adult_child_share(wl).collect()}
    assert shares == {"Adult"}                                      # pandas groupby drops it
    dense = products.band_pct_by_type(wl).collect()
    assert sum(r["total_patients"] for r in dense) == 6              # only the known bands


def test_duplicate_dimension_key_is_reported(spark):
    from queuelens.plans import published
    wl = _wl(spark, [(1999, 1, "A", "0-3 Months", 5)], [], dim_rows=[("A", "G1"), ("A", "G2")])
    dups = published.pk_duplicates(wl).collect()
    assert [(r["specialty_name"], r["occurrences"]) for r in dups] == [("A", 2)]
    assert wl.full().count() == 2                                   # the fan-out the check warns about


def test_constant_values_describe(spark):
    from queuelens.operators import distribution as D
    df = spark.createDataFrame([("a", 7)] * 6, "k string, total int")
    d = D.describe(D.value_counts(df, ["k"], "total"), ["k"], "total").collect()[0]
    assert d["std"] == 0.0 and d["skewness"] is None and d["kurtosis"] is None
    assert d["outliers"] == 0 and d["iqr"] == 0.0 and d["mode"] == 7


def test_mom_shock_per_group(spark):
    ip = [(1999, m, "A", "0-3 Months", v) for m, v in ((1, 100), (2, 120), (3, 121))]
    ip += [(1999, m, "B", "0-3 Months", v) for m, v in ((1, 50), (2, 50), (3, 40))]
    wl = _wl(spark, ip, [], dim_rows=[("A", "G1"), ("B", "G2")])
    rows = {(r["specialty_group"], r["year_month"]): (r["mom_pct_change"], r["change_flag"])
            for r in reports.mom_shock(wl, group_cols=("specialty_group",)).collect()}
    assert rows[("G1", "1999-02")] == (20.0, "⚠ SPIKE")
    assert rows[("G1", "1999-03")] == (0.8, "normal")
    assert rows[("G2", "1999-03")] == (-20.0, "⚠ SPIKE")


def test_year_options_name_growth_columns(spark):
    from queuelens.plans import published
    ip = [(y, 1, "A", "18+ Months", 10 + y - 1996) for y in (1996, 1997, 1998)]
    wl = _wl(spark, ip, [])
    o = Options(early_year=1996, base_year=1997, compare_year=1998)
    g = reports.specialty_growth(wl, o)
    assert {"total_1996", "total_1997", "total_1998"} <= set(g.columns)
    acc = reports.long_wait_acceleration(wl, o)
    assert {"rate_1998", "rate_1996"} <= set(acc.columns)
    coh = published.age_cohort_growth(wl, o)
    assert {"elderly_1996", "elderly_1998"} <= set(coh.columns)
    assert g.collect()[0]["compare_vs_base_pct"] == 9.1        # (12 - 11) * 100 / 11


def test_each_fact_table_scanned_at_most_once(spark):
    """Guards the single-read design (see PLANS.md) against regressions."""
    import re
    from queuelens.plans.registry import all_plans as queries
    for name, fn in queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        for table in ("lineitem", "orders"):
            scans = sum(1 for ln in plan.split("\n")
                        if re.search(r"Scan parquet", ln) and f"{table}.parquet" in ln)
            assert scans <= 1, (name, table, scans)


def test_age_profile_keeps_every_category(spark):
    from queuelens.operators.model import WaitingList
    rows = [(y, a, t) for y, a, t in ((1998, "0-15", 5), (1998, "", 7), (1999, "Unknown", 11), (1999, "0-15", 2))]
    fact = spark.createDataFrame(rows, "year int, age_profile string, total int").selectExpr(
        "make_date(year, 1, 31) AS archive_date", "CAST(NULL AS INT) AS specialty_hipe", "'A' AS specialty_name",
        "'Day Case' AS case_type", "'Adult' AS adult_child", "age_profile", "'18+ Months' AS time_bands", "total", "year")
    dim = spark.createDataFrame([("A", "G")], "specialty_name string, specialty_group string")
    got = {(r["year"], r["age_profile"]): r["total_patients"]
           for r in products.age_by_year(WaitingList(fact, fact.limit(0), dim)).collect()}
    assert got == {(1998, "0-15"): 5, (1998, ""): 7, (1998, "Unknown"): 0,
                   (1999, "0-15"): 2, (1999, ""): 0, (1999, "Unknown"): 11}


def test_a_file_added_between_two_queries_counts(spark, tmp_path):
    import os
    import shutil
    from queuelens.plans.registry import all_plans
    src = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "lineitem"):
        os.symlink(f"{src}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.mkdir(tmp_path / "orders.parquet")
    shutil.copy(f"{src}/orders.parquet", tmp_path / "orders.parquet" / "a.parquet")
    plan = all_plans()["efficiency_scenario"]
    before = plan(spark, str(tmp_path)).collect()
    shutil.copy(f"{src}/orders.parquet", tmp_path / "orders.parquet" / "b.parquet")
    after = plan(spark, str(tmp_path)).collect()
    assert after[0][1] == 2 * before[0][1]


def test_value_count_statistics_never_fall_back_to_sorting(spark):
    """More groups than a percentile aggregate of raw rows would hash."""
    from queuelens.operators import distribution as D
    df = spark.range(20_000).selectExpr("id % 300 AS k", "CAST(id % 17 AS INT) AS total")
    out = D.describe(D.value_counts(df, ["k"], "total"), ["k"], "total")
    rows = out.collect()
    assert len(rows) == 300 and sum(r["n"] for r in rows) == 20_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan_side = plan.split("== Initial Plan ==")[0].rsplit("Exchange", 1)[1]
    assert "HashAggregate" in scan_side and "ObjectHashAggregate" not in scan_side


def test_documents_run_no_job_before_the_caller_does(spark):
    from queuelens.plans.registry import all_plans
    plans, sc = all_plans(), spark.sparkContext
    for name in ("stat_tests", "run_summary", "dashboard_json"):
        sc.setJobGroup(f"building {name}", name)
        plans[name](spark, "/root/testdata/sf0.001")
        assert list(sc.statusTracker().getJobIdsForGroup(f"building {name}")) == []
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_write_dashboard_makes_one_file(spark, tmp_path):
    import json
    from queuelens.plans import export
    path = tmp_path / "dashboard data.json"
    for text in ('{"a":1}', '{"a":2}'):                       # the second takes the place of the first
        export.write_dashboard(spark.createDataFrame([(text,)], "document string"), str(path))
        assert json.loads(path.read_text()) == json.loads(text)
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["dashboard data.json"]


def test_grains_keep_null_keys_apart_from_left_out_ones(spark):
    from queuelens.plans.summary import VALUE, grains, value_counts
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 2), (None, None, 5)], "k string, m string, total int")
    g = grains(rows, first=["k"], second=["m", "k"], values=["k", VALUE])
    assert sorted(map(str, g["first"].frame.collect())) == sorted(
        ["Row(k='a', total=3, records=2)", "Row(k=None, total=7, records=2)"])
    assert g["second"].frame.count() == 4
    assert {(r.k, r.total): r.cnt for r in value_counts(g["values"], "k").collect()} == {("a", 1): 1, ("a", 2): 1, (None, 2): 1, (None, 5): 1}
