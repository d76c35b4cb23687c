"""The rounding and formatting helpers must agree exactly between Spark and
DuckDB: the oracle comparison hashes values, so any drift would show up as a
mismatch. Random values plus values sitting on rounding ties."""

import duckdb
from hypothesis import given, settings, strategies as st

from queuelens.functions import measures as M
from queuelens.plans import sqlkit as S
from queuelens.plans.products import _fmt_sql

TIES = [0.005, 1.005, 2.675, -2.675, 10.04, 5.04, 0.125, -0.125, 1234.5, 999.5, 1499.999, 1e6 - 0.5]


def _spark_vs_duck(spark, values, spark_expr, sql_expr):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(spark_expr).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, float(v)) for i, v in enumerate(values)])
    want = [r[0] for r in con.execute(f"SELECT {sql_expr} FROM t ORDER BY i").fetchall()]
    return got, want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e7, max_value=1e7, allow_nan=False), min_size=20, max_size=60),
       st.integers(min_value=0, max_value=4))
def test_round_half_same_in_both_engines(spark, values, digits):
    values = values + TIES
    got, want = _spark_vs_duck(spark, values, M.round_half("x", digits), S.rnd("x", digits))
    assert got == want


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=5e7, allow_nan=False), min_size=20, max_size=60))
def test_human_format_same_in_both_engines(spark, values):
    values = values + [v for v in TIES if v >= 0] + [999.0, 1000.0, 999999.0, 1e6, 1.25e6]
    got, want = _spark_vs_duck(spark, values, M.human_format("x"), _fmt_sql("x"))
    assert got == want


def test_pct_same_in_both_engines(spark):
    import itertools
    pairs = list(itertools.product([0, 1, 3, 7, 11, 1234567, 99999999], [0, 1, 3, 7, 13, 7654321]))
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(M.round_half(M.pct("a", "b"), 2)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = [r[0] for r in con.execute(f"SELECT {S.rnd(S.pct('a', 'b'), 2)} FROM t ORDER BY i").fetchall()]
    assert got == want
