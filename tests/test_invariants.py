"""Cross-report invariants on the small synthetic tables."""

import pytest

from queuelens.plans import products, published, reports, statistics
from queuelens.plans.registry import waiting_list_from_testdata
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def wl(spark):
    return waiting_list_from_testdata(spark, SF_SMALL)


def test_shares_sum_to_100(wl):
    for df, key, col in ((reports.band_profile(wl), "patient_type", "pct_of_type"),
                         (reports.age_band_profile(wl), "age_profile", "pct_within_age_group"),
                         (products.band_pct_by_type(wl), "patient_type", "pct_of_type")):
        sums = {}
        for r in df.collect():
            sums[r[key]] = sums.get(r[key], 0.0) + r[col]
        assert all(abs(v - 100.0) < 0.05 for v in sums.values())


def test_pivot_sum_equals_long_sum(wl):
    piv = products.annual_pivot(wl).collect()
    tot = sum((r["inpatient"] or 0) + (r["outpatient"] or 0) for r in piv)
    kp = products.kpis(wl).collect()[0]
    assert tot == kp["total_patients"] == kp["inpatient_total"] + kp["outpatient_total"]
    age = products.age_by_year(wl).collect()
    assert sum(r["total_patients"] for r in age) == kp["total_patients"]


def test_types_add_up_to_combined(wl):
    rows = {r["dataset"]: r for r in products.descriptive_table(wl).collect()}
    assert rows["Inpatient"]["n"] + rows["Outpatient"]["n"] == rows["Combined"]["n"]
    assert rows["Inpatient"]["sum_total"] + rows["Outpatient"]["sum_total"] == rows["Combined"]["sum_total"]


def test_mann_whitney_u_complement(wl):
    m = statistics.mann_whitney_u(wl).collect()[0]
    assert 0 <= m["u"] <= m["n1"] * m["n2"]


def test_running_total_ends_at_type_total(wl):
    last = {}
    for r in reports.running_backlog(wl).collect():
        if r["patient_type"] not in last or r["year_month"] > last[r["patient_type"]][0]:
            last[r["patient_type"]] = (r["year_month"], r["cumulative_total"])
    share = {r["patient_type"]: r["total_patients"] for r in published.type_share(wl).collect()}
    assert {k: v[1] for k, v in last.items()} == share


def test_long_wait_scale_matches_kpis(wl):
    rows = {r["metric"]: r["value"] for r in reports.long_wait_scale(wl).collect()}
    g = reports.group_long_wait(wl).collect()
    assert rows["TOTAL 18+ MONTH WAITERS"] == sum(r["long_waiters"] for r in g)


def test_chi2_expected_margins(wl):
    ex = products.chi2_residuals(wl).collect()
    assert sum(r["observed"] for r in ex) == pytest.approx(sum(r["expected"] for r in ex), rel=1e-6)


def test_dashboard_document_sections(wl):
    import json
    from queuelens.plans import export
    doc = json.loads(export.dashboard_json(wl).collect()[0]["document"])
    assert list(doc) == ["kpis", "annual", "monthly", "time_bands", "top_ip", "top_op", "age", "adult_child",
                         "spec_groups", "desc_stats", "stat_tests", "long_wait_trend", "case_type"]
    kp = products.kpis(wl).collect()[0].asDict()
    assert doc["kpis"] == {k: kp[k] for k in doc["kpis"]}
    assert len(doc["time_bands"]["inpatient"]) == 7 and len(doc["case_type"]["labels"]) == 7
    assert len(doc["monthly"]["labels"]) == len(doc["long_wait_trend"]["labels"])
    assert [d["Dataset"] for d in doc["desc_stats"]] == ["Inpatient", "Outpatient", "Combined"]
    from queuelens.functions.constants import DESCRIPTION_KEYS
    assert all(list(d) == list(DESCRIPTION_KEYS) for d in doc["desc_stats"])
    top = [r["specialty_name"] for r in products.top_specialties(wl).collect() if r["patient_type"] == "Inpatient"]
    assert doc["top_ip"]["labels"] == top


def test_run_summary_matches_kpis(wl):
    from queuelens.plans import export
    rs = export.run_summary(wl).collect()[0]
    kp = products.kpis(wl).collect()[0]
    assert rs["total_patient_waits"] == kp["total_patients"] and rs["long_wait"] == kp["long_wait"]
    assert rs["long_wait_pct"] == kp["long_wait_pct"]
