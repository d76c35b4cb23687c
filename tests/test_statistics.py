"""Formula checks against independent pandas / numpy computations on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import pvalue_reference as P
from queuelens.functions import tails as TL
from queuelens.functions import measures as M
from queuelens.operators import distribution as D
from queuelens.operators.contingency import chi_square, crosstab_long, expected
from queuelens.operators.ranktests import kruskal_wallis, mann_whitney, rank_sums, spearman


def _midranks(x):
    return pd.Series(x).rank(method="average").to_numpy()


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,), (0.125,), (None,)], "x double")
    got = [r[0] for r in df.select(M.round_half("x", 2).alias("r")).collect()]
    assert got[1] == 2.5 and got[2] == -2.5 and got[4] is None
    r0 = [r[0] for r in df.select(M.round_half("x", 0).alias("r")).collect()]
    assert r0[1] == 3.0 and r0[2] == -3.0


def test_describe_matches_pandas(spark):
    vals = [1, 2, 2, 3, 7, 10, 10, 10, 40, 0, 5, 5]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, total int")
    d = D.describe(D.value_counts(df, ["k"], "total"), ["k"], "total").collect()[0]
    s = pd.Series(vals)
    assert d["n"] == len(vals) and d["sum"] == s.sum()
    assert d["mean"] == pytest.approx(s.mean())
    assert d["median"] == pytest.approx(s.median())
    assert d["std"] == pytest.approx(s.std())
    assert d["skewness"] == pytest.approx(s.skew())
    assert d["kurtosis"] == pytest.approx(s.kurtosis())
    assert d["mode"] == int(s.mode()[0])
    for q, name in ((0.25, "q1"), (0.75, "q3"), (0.05, "p5"), (0.95, "p95"), (0.99, "p99")):
        assert d[name] == pytest.approx(s.quantile(q))
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = q3 - q1
    assert d["outliers"] == int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())


def test_mode_smallest_on_tie_and_one_row_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("b", 9)], "k string, total int")
    rows = {r["k"]: r for r in D.describe(D.value_counts(df, ["k"], "total"), ["k"], "total").collect()}
    assert rows["a"]["mode"] == 1
    assert rows["b"]["std"] is None and rows["b"]["skewness"] is None


def test_kruskal_matches_midrank_formula(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 4, 300)
    v = rng.integers(0, 12, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(g, v)], "year int, total int")
    h = kruskal_wallis(D.value_counts(df, ["year"], "total"), "year").collect()[0]["h"]
    r = _midranks(v)
    n = len(v)
    hh = 12.0 / (n * (n + 1)) * sum(r[g == k].sum() ** 2 / (g == k).sum() for k in range(4)) - 3 * (n + 1)
    _, t = np.unique(v, return_counts=True)
    hh /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    assert h == pytest.approx(hh)


def test_mann_whitney_u_sum(spark):
    rows = [("A", 1), ("A", 3), ("A", 3), ("B", 2), ("B", 3), ("B", 5), ("B", 8)]
    df = spark.createDataFrame(rows, "g string, total int")
    m = mann_whitney(D.value_counts(df, ["g"], "total"), "g", "A").collect()[0]
    r = _midranks([v for _, v in rows])
    u1 = r[:3].sum() - 3 * 4 / 2
    assert m["u"] == pytest.approx(u1)
    assert m["n1"] * m["n2"] - m["u"] + m["u"] == 12


def test_chi_square_yates_for_two_by_two(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 5
    df = spark.createDataFrame(rows, "a string, b string")
    c = chi_square(crosstab_long(df, "a", "b"), "a", "b").collect()[0]
    obs = np.array([[10, 20], [30, 5]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = obs + np.minimum(0.5, np.abs(e - obs)) * np.sign(e - obs)
    assert c["dof"] == 1
    assert c["chi2"] == pytest.approx(((adj - e) ** 2 / e).sum())


def test_crosstab_keeps_zero_cells(spark):
    rows = [("x", "p"), ("x", "q"), ("y", "p")]
    ct = crosstab_long(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    got = {(r["a"], r["b"]): r["observed"] for r in ct.collect()}
    assert got[("y", "q")] == 0 and len(got) == 4
    ex = expected(ct, "a", "b").collect()
    assert sum(r["expected"] for r in ex) == pytest.approx(3.0)


def test_spearman_ties(spark):
    x = [1, 2, 3, 4, 5, 6]
    y = [2.0, 1.0, 4.0, 4.0, 6.0, 5.0]
    df = spark.createDataFrame(list(zip(x, y)), "x int, y double")
    rho = spearman(df, "x", "y").collect()[0]["rho"]
    assert rho == pytest.approx(np.corrcoef(_midranks(x), _midranks(y))[0, 1])


def test_tail_probabilities():
    assert P.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert P.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-7)
    assert P.chi2_sf(12.591587243743977, 6) == pytest.approx(0.05, rel=1e-7)
    assert P.chi2_sf(0.0, 3) == 1.0
    assert P.t_two_sided(2.228138851986274, 10) == pytest.approx(0.05, rel=1e-7)
    assert P.corr_p(1.0, 4) == 0.0
    assert math.isnan(P.corr_p(0.5, 2))


def test_histogram_all_bins_and_clip(spark):
    vals = list(range(1, 101))
    df = spark.createDataFrame([("a", v) for v in vals], "k string, total int")
    h = D.histogram(D.value_counts(df, ["k"], "total"), ["k"], "total", 10, 0.98).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["frequency"] for r in h) == 100
    clip = pd.Series(vals).quantile(0.98)
    counts, _ = np.histogram(np.minimum(vals, clip), bins=10)
    assert [r["frequency"] for r in h] == list(counts)


def test_histogram_constant_values(spark):
    df = spark.createDataFrame([("a", 4)] * 5, "k string, total int")
    h = D.histogram(D.value_counts(df, ["k"], "total"), ["k"], "total", 4, 0.98).collect()
    assert sum(r["frequency"] for r in h) == 5 and len(h) == 4


def test_kde_matches_numpy(spark):
    xs = np.log1p(np.array([1, 2, 2, 5, 9, 30, 4, 4, 4]))
    df = spark.createDataFrame([("a", float(x)) for x in xs], "k string, x double")
    vc = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias(D.CNT))
    got = D.gaussian_kde(vc, ["k"], "x", 5).orderBy("point").collect()
    bw = xs.std(ddof=1) * len(xs) ** -0.2
    grid = np.linspace(xs.min(), xs.max(), 5)
    want = [np.exp(-0.5 * ((g - xs) / bw) ** 2).sum() / (len(xs) * bw * math.sqrt(2 * math.pi)) for g in grid]
    assert [r["density"] for r in got] == pytest.approx(want)


@pytest.mark.parametrize("cells", [16, 200, 16384])
def test_kde_of_wide_domain_within_its_bound(spark, cells):
    rng = np.random.default_rng(cells)
    sets = {"a": rng.normal(0, 1, 3000), "b": np.exp(rng.normal(0, 1, 2000)) + 1e6}
    df = spark.createDataFrame([(k, float(x)) for k, xs in sets.items() for x in xs], "k string, x double")
    got = D.gaussian_kde(D.value_counts(df, ["k"], "x"), ["k"], "x", 50, cells).orderBy("k", "point").collect()
    assert len(got) == 100
    for k, xs in sets.items():
        bw = xs.std(ddof=1) * len(xs) ** -0.2
        for r, t in zip([r for r in got if r["k"] == k], np.linspace(xs.min(), xs.max(), 50), strict=True):
            exact = np.exp(-0.5 * ((t - xs) / bw) ** 2).sum() / (len(xs) * bw * math.sqrt(2 * math.pi))
            assert r["error_bound"] == pytest.approx(0.0115 * (np.ptp(xs) / cells) ** 3 / bw ** 4, rel=1e-6)
            assert abs(r["density"] - exact) <= r["error_bound"] + 1e-9
            if cells == 16384:
                assert r["density"] == pytest.approx(exact, abs=1e-6)


def test_kde_one_row_equal_values_and_empty(spark):
    df = spark.createDataFrame([("one", 3.0), ("same", 2.0), ("same", 2.0)], "k string, x double")
    vc = D.value_counts(df, ["k"], "x")
    got = D.gaussian_kde(vc, ["k"], "x", 3).collect()
    assert len(got) == 6 and all(r["density"] is None and r["error_bound"] is None for r in got)
    assert {(r["k"], r["coord"]) for r in got} == {("one", 3.0), ("same", 2.0)}
    assert D.gaussian_kde(vc.limit(0), ["k"], "x", 3).collect() == []


def test_box_stats_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("a", float(v)) for v in vals], "k string, x double")
    vc = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias(D.CNT))
    b = D.box_stats(vc, ["k"], "x").collect()[0]
    assert b["q1"] == 3.0 and b["q3"] == 7.0 and b["whisker_high"] == 8.0 and b["fliers"] == 1


def test_midranks_across_value_buckets(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, 400)
    df = spark.createDataFrame([("a", int(x)) for x in v], "k string, total int")
    vc = D.value_counts(df, ["k"], "total")
    got = rank_sums(vc, "k", "total", bucket_width=7).collect()[0]
    assert got["n"] == 400 and got["rank_sum"] == pytest.approx(sum(_midranks(v)))
    ties = np.unique(v, return_counts=True)[1].astype(float)
    assert got["ties"] == pytest.approx((ties ** 3 - ties).sum())


def test_equal_samples_have_p_one(spark):
    rows = [(g, t) for g in "ab" for t in (1, 2, 3)]
    vc = D.value_counts(spark.createDataFrame(rows, "k string, total int"), ["k"], "total")
    m = TL.with_normal_two_sided(mann_whitney(vc, "k", "a"), "z", "p").collect()[0]
    assert m["z"] == 0.0 and m["p"] == 1.0


def test_chi2_tail_with_many_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1e6, 1_000_000), (10_100.0, 10_000)], "x double, k int")
    near, far = (r["p"] for r in TL.with_chi2_sf(df, "x", "k", "p").orderBy(F.desc("k")).collect())
    assert near == pytest.approx(0.49981194, abs=1e-5)
    assert far == pytest.approx(0.2391, abs=2e-3)


def test_jvm_tails_match_reference(spark):
    rows = [(float(x), k) for k in (1, 2, 3, 6, 11, 30) for x in (0.01, 0.7, 3.84, 9.0, 25.0, 120.0)]
    df = spark.createDataFrame(rows, "x double, k int")
    for r in TL.with_chi2_sf(df, "x", "k", "p").collect():
        assert r["p"] == pytest.approx(P.chi2_sf(r["x"], r["k"]), rel=1e-10)
    zs = spark.createDataFrame([(z,) for z in (0.0, 0.3, 1.96, 4.0, 9.0)], "z double")
    for r in TL.with_normal_two_sided(zs, "z", "p").collect():
        assert r["p"] == pytest.approx(2 * P.normal_sf(abs(r["z"])), rel=1e-10)
    rn = spark.createDataFrame([(r, n) for r in (-0.8, 0.1, 0.5, 0.99) for n in (3, 4, 9, 50)] + [(1.0, 5), (0.3, 2)],
                               "r double, n int")
    for r in TL.with_corr_two_sided(rn, "r", "n", "p").collect():
        want = P.corr_p(r["r"], r["n"])
        if math.isnan(want):
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_exact_mann_whitney_against_all_orders(spark):
    import itertools
    import random

    from queuelens.operators.ranktests import mann_whitney, with_mann_whitney_p
    rng = random.Random(1)
    rows, want = [], {}
    for key, (n1, n2) in enumerate([(1, 1), (1, 5), (2, 3), (3, 3), (4, 6), (5, 5), (7, 2), (8, 4), (8, 7), (9, 9), (1, 2000)]):
        v = rng.sample(range(100_000), n1 + n2)
        rows += [(key, "a" if i < n1 else "b", x, 1) for i, x in enumerate(v)]
        u = sum(a > b for a in v[:n1] for b in v[n1:])
        low = min(u, n1 * n2 - u)
        if n1 == 1:
            want[key] = (u, True, min(1.0, 2 * (low + 1) / (n2 + 1)))
        elif n1 > 8:
            want[key] = (u, False, None)
        else:
            all_u = [sum(s) - n1 * (n1 - 1) // 2 for s in itertools.combinations(range(n1 + n2), n1)]
            want[key] = (u, True, min(1.0, 2 * sum(x <= low for x in all_u) / len(all_u)))
    rows += [(50, "a", 1, 1), (50, "b", 1, 1), (50, "b", 2, 1), (51, "a", 3, 1), (52, "b", 3, 2)]
    df = spark.createDataFrame(rows, "k int, g string, total long, cnt long")
    got = {r["k"]: r for r in with_mann_whitney_p(mann_whitney(df, "g", "a", by=["k"])).collect()}
    for key, (u, exact, p) in want.items():
        assert (got[key]["u"], got[key]["exact"]) == (u, exact)
        assert p is None or abs(got[key]["p_value"] - p) < 1e-12
    assert not got[50]["exact"] and got[50]["p_value"] == 1.0            # ties: the approximation
    assert got[51]["p_value"] is None and got[52]["p_value"] is None     # one sample alone
