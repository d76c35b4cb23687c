"""Ingest of the yearly snapshot CSV files and the specialty mapping.

All yearly files are read as strings (no schema inference) in one scan; every
file's own header says which field is which column, so files with different
headers are appended by column name, missing columns padded with nulls. One
job finds all headers. The year comes from the file name.
Cleaning stays in JVM expressions: whitespace strip, band normalisation,
day-first date parsing, integer casts. Every input line ends up either clean
or in a reject table with its reason: lines with extra or missing fields,
dates and totals that cannot be parsed or do not fit, damaged codes.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.functions.constants import LONG_WAIT_BAND, LONG_WAIT_BAND_VARIANT
from queuelens.functions.measures import strip_ws

# --- fixed values: header spellings seen in the source files ---------------
HEADER_ALIASES = {
    "Speciality": "Specialty_Name",
    "Speciality_Name": "Specialty_Name",
    "Age_Categorisation": "Age_Profile",
}
# Raw header -> canonical column.
CANONICAL_NAMES = {
    "Archive_Date": "archive_date",
    "Group": "hospital_group",
    "Hospital_HIPE": "hospital_hipe",
    "Specialty_HIPE": "specialty_hipe",
    "Specialty_Name": "specialty_name",
    "Case_Type": "case_type",
    "Adult_Child": "adult_child",
    "Age_Profile": "age_profile",
    "Time_Bands": "time_bands",
    "Total": "total",
}
# Day-first layouts accepted for Archive_Date, tried in order.
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-MM-dd")

_UNNAMED = re.compile(r"^(_c\d+|Unnamed.*|)$")
REJECT_REASON = "_reject_reason"
BAD_LINE, BROKEN = "_bad_line", "_broken"
FEW_FILES = 100_000        # tables of so many files at most are broadcast
WHOLE_NUMBERS = ("total", "specialty_hipe", "hospital_hipe")


def _first_lines(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, header line) of every file, from one job over all of them; a line per file reaches the driver."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("place"))
    first = (lines.filter((F.col("start") == 0) & (F.trim("value") != ""))
             .groupBy("path").agg(F.min_by("value", "place").alias("line")))
    return [(r["path"], r["line"]) for r in first.collect()]


def _names(line: str) -> list[str]:
    """Canonical column names of a header line, in its order."""
    fields = next(csv.reader([line.lstrip("\ufeff")]))
    return [HEADER_ALIASES.get(f.strip(), f.strip()) for f in fields]


def _field_count(line: F.Column) -> F.Column:
    """Fields of a CSV line; commas inside quotes do not count."""
    plain = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))) + 1
    return F.when(F.contains(line, F.lit('"')), F.size(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))).otherwise(plain)


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as strings by canonical header, in one scan whatever their headers.

    The scan reads fields by place, as many as the widest header has. A small
    table says at which place each file has which column; every row looks its
    places up by its file's name. Lines with too many or too few fields for
    their own file's header are marked.
    """
    headers = [(path, _names(line)) for path, line in _first_lines(spark, paths)]
    width = max((len(names) for _, names in headers), default=1)
    columns = list(dict.fromkeys(n for _, names in headers for n in names if not _UNNAMED.match(n)))
    rows = []
    for path, names in headers:
        named = [i for i, n in enumerate(names) if not _UNNAMED.match(n)]
        rows.append((path, len(names), named[-1] + 1 if named else 0, [names.index(c) if c in names else None for c in columns]))
    known = spark.createDataFrame(rows, "_path string, _fields int, _least int, _at array<int>")
    schema = T.StructType([T.StructField(f"_f{i}", T.StringType()) for i in range(width)]
                          + [T.StructField(BAD_LINE, T.StringType())])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
           .option("columnPruning", False)            # a pruned line would not show its extra fields
           .option("columnNameOfCorruptRecord", BAD_LINE).csv(paths))
    # file names arrive URL-encoded ("inpatient%202018.csv"): decode before matching
    name = F.url_decode(F.col("_metadata.file_name"))
    year = F.nullif(F.regexp_extract(name, r"(\d{4})", 1), F.lit("")).cast("int")
    raw = raw.select(F.array(*[f"_f{i}" for i in range(width)]).alias("_values"), BAD_LINE,
                     year.alias("year"), F.col("_metadata.file_path").alias("_file"))
    known = F.broadcast(known) if len(rows) <= FEW_FILES else known
    raw = raw.join(known, F.col("_file") == F.col("_path"), "left")
    # the reader marks every line that is shorter or longer than the widest header
    fields = F.when(F.col(BAD_LINE).isNull(), F.lit(width)).otherwise(_field_count(F.col(BAD_LINE)))
    broken = (F.when(fields > F.col("_fields"), F.lit("extra fields"))
              .when(fields < F.col("_least"), F.lit("missing fields"))
              .when(F.col(BAD_LINE).isNotNull() & (fields == width), F.lit("malformed line")))
    return raw.select(*(F.get("_values", F.get("_at", F.lit(i))).alias(c) for i, c in enumerate(columns)),
                      broken.alias(BROKEN), "year")


def _parse_date(c) -> F.Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)).cast("date") for fmt in DATE_FORMATS])


def normalise_band(c) -> F.Column:
    s = strip_ws(c)
    return F.when(s == F.lit(LONG_WAIT_BAND_VARIANT), F.lit(LONG_WAIT_BAND)).otherwise(s)


def clean_facts(df: DataFrame, blank_as_null: bool = False) -> DataFrame:
    """Strip strings, normalise bands, parse dates and numbers; add reject reason."""
    out = []
    for c in df.columns:
        if c in ("year", BROKEN):
            continue
        e = strip_ws(F.col(f"`{c}`"))
        if blank_as_null:
            e = F.nullif(e, F.lit(""))
        out.append(e.alias(c))
    broken = F.col(BROKEN) if BROKEN in df.columns else F.lit(None).cast("string")
    df = df.select(*out, "year", broken.alias(BROKEN))
    cols = set(df.columns)
    exprs, damaged = [], []
    for raw_name, name in CANONICAL_NAMES.items():
        if raw_name not in cols:
            exprs.append(F.lit(None).cast("string").alias(name))
            continue
        c = F.col(f"`{raw_name}`")
        if name == "archive_date":
            c = _parse_date(c)
        elif name in WHOLE_NUMBERS:
            x = c.try_cast("double")
            n = F.when(x == F.floor(x), x).try_cast("int")
            if name != "total":
                damaged.append((F.coalesce(c, F.lit("")) != "") & n.isNull())
                exprs.append(damaged[-1].alias(f"_bad_{name}"))
            c = n
        elif name == "time_bands":
            c = normalise_band(c)
        exprs.append(c.alias(name))
    parsed = df.select(*exprs, F.col("year"), F.col(BROKEN))
    marks = [c for c in parsed.columns if c.startswith("_bad_")]
    reason = (F.when(F.col(BROKEN).isNotNull(), F.col(BROKEN))
              .when(F.col("archive_date").isNull(), F.lit("bad archive_date"))
              .when(F.col("total").isNull(), F.lit("bad total"))
              .when(F.col("specialty_name").isNull(), F.lit("missing specialty_name"))
              .when(F.col("year").isNull(), F.lit("no year in file name")))
    for m in marks:
        reason = reason.when(F.col(m), F.lit(m.removeprefix("_").replace("_", " ", 1)))
    return parsed.withColumn(REJECT_REASON, reason).drop(BROKEN, *marks)


def read_fact_csv(spark: SparkSession, paths: list[str], blank_as_null: bool = False):
    """Read yearly fact files; returns (clean rows, rejected rows)."""
    cleaned = clean_facts(read_raw(spark, paths), blank_as_null)
    good = cleaned.filter(F.col(REJECT_REASON).isNull()).drop(REJECT_REASON)
    bad = cleaned.filter(F.col(REJECT_REASON).isNotNull())
    return good, bad


def read_inpatient_csv(spark, paths, blank_as_null=False):
    good, bad = read_fact_csv(spark, paths, blank_as_null)
    return good.select("archive_date", "specialty_hipe", "specialty_name", "case_type",
                       "adult_child", "age_profile", "time_bands", "total", "year"), bad


def read_outpatient_csv(spark, paths, blank_as_null=False):
    good, bad = read_fact_csv(spark, paths, blank_as_null)
    return good.select("archive_date", "specialty_hipe", "specialty_name",
                       "adult_child", "age_profile", "time_bands", "total", "year"), bad


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Specialty -> group mapping (header ``Specialty,Specialty Group``)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = raw.toDF(*[c.strip() for c in raw.columns])
    return df.select(strip_ws(F.col("Specialty")).alias("specialty_name"),
                     strip_ws(F.col("`Specialty Group`")).alias("specialty_group"))
