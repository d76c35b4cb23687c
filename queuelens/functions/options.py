"""Report parameters.

The reference analyses fixed calendar years; here every year, threshold and
rate is a parameter. Defaults fit the synthetic test tables (years
1995-2001, last year partial).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from queuelens.functions.constants import LONG_WAIT_BAND


@dataclass(frozen=True)
class Options:
    early_year: int = 1998          # first year of the growth comparisons
    base_year: int = 1999           # year before the shock
    compare_year: int = 2000        # shock year
    partial_year: int = 2001        # last, incomplete year
    marker_month: str = "2000-03"   # month marked on monthly panels
    pre_years: tuple = (1998, 1999)
    post_years: tuple = (2000, 2001)
    long_band: str = LONG_WAIT_BAND
    risk_thresholds: tuple = (7.0, 4.0)         # HIGH >=, MEDIUM >=
    mom_thresholds: tuple = (10.0, 5.0)         # SPIKE >, ELEVATED >
    trend_thresholds: tuple = (5.0, 2.0, -2.0)  # FAST >, WORSENING >, IMPROVING <
    min_total: int = 10000          # surge candidates: SUM(total) >
    rate: float = 0.05              # efficiency scenario
    drop_null_age: bool = False     # SQL views keep null ages; pandas drops them
    winsor_quantile: float = 0.98
    hist_bins: int = 50
    kde_points: int = 100
    top_volume: int = 15
    top_growth: int = 20
    top_stats: int = 20
    top_surge: int = 5
    top_per_type: int = 10
    heatmap_top: int = 15
    delta_min_abs: float = 0.1
    delta_rows: int = 18
    group_top: int = 15
    years: tuple | None = field(default=None)   # None: every year present

    @property
    def growth_years(self) -> tuple:
        return (self.early_year, self.base_year, self.compare_year)
