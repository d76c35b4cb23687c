"""Fixed values.

These strings must equal the source data and the published report labels
exactly for the results to be right; they are stated here once, in their
natural order.
"""

# --- fixed values: ordered waiting-time bands (shortest first) -------------
TIME_BANDS = (
    "0-3 Months",
    "3-6 Months",
    "6-9 Months",
    "9-12 Months",
    "12-15 Months",
    "15-18 Months",
    "18+ Months",
)
# The band that defines a "long wait".
LONG_WAIT_BAND = "18+ Months"
# Spelling variant of the long band found in raw files.
LONG_WAIT_BAND_VARIANT = "18 Months +"

# --- fixed values: category labels -----------------------------------------
PATIENT_TYPES = ("Inpatient", "Outpatient")
CASE_TYPES = ("Inpatient", "Day Case")
ADULT_CHILD = ("Adult", "Child")
AGE_PROFILES = ("0-15", "16-64", "65+")
ELDERLY_AGE = "65+"
CHILD = "Child"
DEFAULT_GROUP = "Other"

# --- fixed values: report labels -------------------------------------------
RISK_LABELS = ("HIGH", "MEDIUM", "LOW")
MOM_LABELS = ("⚠ SPIKE", "! ELEVATED", "normal")
TREND_LABELS = ("WORSENING FAST", "WORSENING", "IMPROVING", "STABLE")
LONG_WAIT_SCALE_LABELS = ("TOTAL 18+ MONTH WAITERS", "% OF ALL PATIENTS")
SCENARIO_LABELS = ("Current Outpatient Total", "5% Efficiency Gain Would Clear")
SIGNIFICANCE_LABELS = ("SIGNIFICANT", "NOT SIGNIFICANT")
TREND_TEST_LABELS = ("Upward trend SIGNIFICANT", "No significant trend")
STRENGTH_LABELS = ("Strong", "Moderate", "Weak")
# Cramer's V cut points for the strength label (strictly greater than).
STRENGTH_CUTS = (0.3, 0.1)
SIGNIFICANCE_ALPHA = 0.05

# --- fixed values: keys of a described data set in the dashboard document ---
DESCRIPTION_KEYS = (
    "Dataset", "N (records)", "Sum", "Mean", "Median", "Mode", "Std Dev", "Variance", "Min", "Max", "Range",
    "Q1", "Q3", "IQR", "P5", "P95", "P99", "CV (%)", "Skewness", "Kurtosis", "Outliers (IQR)",
)
