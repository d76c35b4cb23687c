"""Independent SQL formulations of the reports (DuckDB dialect).

Each oracle rebuilds the canonical facts from the raw synthetic tables as
CTEs, so it shares no code path with the Spark plans. Helpers below only
produce SQL text; rounding and ratios follow the same double-precision
rules as ``functions.measures``.
"""

from __future__ import annotations

from queuelens.functions.constants import TIME_BANDS


def rnd(expr: str, digits: int = 0) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"(sign({expr}) * floor(abs({expr}) * {scale} + 0.5) / {scale})"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def pct(num: str, den: str) -> str:
    return f"({dbl(num)} * 100.0 / NULLIF({dbl(den)}, 0))"


def ratio(num: str, den: str) -> str:
    return f"({dbl(num)} / NULLIF({dbl(den)}, 0))"


def lw(cond: str = "time_bands = '18+ Months'", value: str = "total") -> str:
    return f"SUM(CASE WHEN {cond} THEN {value} ELSE 0 END)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _band_case(index_expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(TIME_BANDS))
    return f"CASE {index_expr} {whens} END"


def band_order(c: str = "time_bands") -> str:
    whens = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(TIME_BANDS, start=1))
    return f"CASE {c} {whens} ELSE 8 END"


def _wait_rank(c: str = "time_bands") -> str:
    whens = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(TIME_BANDS))
    return f"CASE {c} {whens} END"


ADAPTER = f"""
dim_specialty AS (
  SELECT n.n_name AS specialty_name, r.r_name AS specialty_group
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE r.r_name <> 'MIDDLE EAST'
),
fact_inpatient AS (
  SELECT CAST(l.l_shipdate AS DATE) AS archive_date,
         CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE CAST(l.l_suppkey AS INTEGER) END AS specialty_hipe,
         n.n_name AS specialty_name,
         CASE l.l_linestatus WHEN 'F' THEN 'Day Case' WHEN 'O' THEN 'Inpatient' END AS case_type,
         CASE WHEN l.l_returnflag = 'A' THEN 'Child' ELSE 'Adult' END AS adult_child,
         CASE l.l_returnflag WHEN 'A' THEN '0-15' WHEN 'N' THEN '16-64' WHEN 'R' THEN '65+' END AS age_profile,
         {_band_case("CAST(floor(round(l.l_discount * 100.0) * 7.0 / 11.0) AS INTEGER)")} AS time_bands,
         CAST(floor(l.l_quantity) AS INTEGER) AS total,
         CAST(year(l.l_shipdate) AS INTEGER) AS year
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
),
fact_outpatient AS (
  SELECT CAST(o.o_orderdate AS DATE) AS archive_date,
         CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(o.o_custkey AS INTEGER) END AS specialty_hipe,
         n.n_name AS specialty_name,
         CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
              WHEN o.o_orderstatus = 'P' THEN 'Child' ELSE 'Adult' END AS adult_child,
         CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
              ELSE CASE o.o_orderstatus WHEN 'P' THEN '0-15' WHEN 'O' THEN '16-64' WHEN 'F' THEN '65+' END
         END AS age_profile,
         CASE substr(o.o_orderpriority, 1, 1)
              WHEN '1' THEN '0-3 Months' WHEN '2' THEN '3-6 Months' WHEN '3' THEN '6-9 Months'
              WHEN '4' THEN '9-12 Months' WHEN '5' THEN '18+ Months' END AS time_bands,
         CAST(floor(o.o_totalprice / 5000.0) AS INTEGER) AS total,
         CAST(year(o.o_orderdate) AS INTEGER) AS year
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
vw_waiting_list AS (
  SELECT archive_date, specialty_name, adult_child, age_profile, time_bands, total, year,
         'Inpatient' AS patient_type, case_type, specialty_hipe
  FROM fact_inpatient
  UNION ALL
  SELECT archive_date, specialty_name, adult_child, age_profile, time_bands, total, year,
         'Outpatient' AS patient_type, CAST(NULL AS VARCHAR) AS case_type, specialty_hipe
  FROM fact_outpatient
),
vw_waiting_list_full AS (
  SELECT w.*, COALESCE(s.specialty_group, 'Other') AS specialty_group,
         strftime(w.archive_date, '%Y-%m') AS year_month,
         CAST(month(w.archive_date) AS INTEGER) AS month,
         {_wait_rank("w.time_bands")} AS wait_rank
  FROM vw_waiting_list w
  LEFT JOIN dim_specialty s ON w.specialty_name = s.specialty_name
),
combined AS (
  SELECT * FROM vw_waiting_list_full
  WHERE patient_type = 'Inpatient' OR age_profile IS NOT NULL
)"""


def with_adapter(body: str, ctes: str = "") -> str:
    """Prefix the adapter CTEs (and optional extra CTEs) to a SELECT."""
    extra = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"WITH {ADAPTER.strip()}{extra}\n{body.strip()}"
