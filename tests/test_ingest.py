"""Messy yearly CSV files: header variants, padding, tabs, band spelling, rejects."""

import os
import tempfile

from pyspark.sql import functions as F

from queuelens.operators.model import WaitingList
from queuelens.plans import reports
from queuelens.sources.csv_ingest import read_inpatient_csv, read_mapping_csv, read_outpatient_csv
from queuelens.sources.store import INPATIENT_SCHEMA, read_fact_store, write_fact_store

IN_HEADER = " Archive_Date , Group, Hospital_HIPE, Specialty_HIPE, Specialty_Name, Case_Type, Adult_Child, Age_Profile, Time_Bands, Total,"


def _write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")
    return path


def _fixtures():
    d = tempfile.mkdtemp(prefix="ql-csv-")
    ip18 = _write(d, "inpatient 2018.csv", [
        IN_HEADER,
        "31/01/2018,G1,1, 10 ,  Cardiology ,Inpatient,Adult,16-64, 0-3 Months,5,",
        "28/02/2018,G1,1,,Cardiology\t,Day Case,Child,0-15,18 Months +,7,",
        "not a date,G1,1,10,Cardiology,Inpatient,Adult,16-64,0-3 Months,3,",
    ])
    ip19 = _write(d, "inpatient 2019.csv", [
        IN_HEADER,
        "15/03/2019,G2,2,11,Unknown Ward,Inpatient,Adult,65+,18+ Months,11,",
    ])
    op18 = _write(d, "outpatient 2018.csv", [
        "Archive_Date,Group,Hospital_HIPE,Specialty_HIPE,Speciality,Adult_Child,Age_Profile,Time_Bands,Total",
        "31/01/2018,G1,1,10,Cardiology,Adult,,3-6 Months,20",
        "31/01/2018,G1,1,10,Cardiology,Child,  ,3-6 Months,4",
    ])
    op19 = _write(d, "outpatient 2019.csv", [
        "Archive_Date,Group,Hospital_HIPE,Specialty_HIPE,Speciality_Name,Adult_Child,Age_Profile,Time_Bands,Total",
        "31/12/2019,G1,1,10,Cardiology,Adult,65+,18+ Months,30",
    ])
    mp = _write(d, "specialty_mapping.csv", ["Specialty,Specialty Group", "Cardiology,Heart", "Urology,Other"])
    return d, [ip18, ip19], [op18, op19], mp


def test_ingest_cleans_and_rejects(spark):
    _, ips, ops, mp = _fixtures()
    ip, ip_bad = read_inpatient_csv(spark, ips)
    rows = sorted(ip.collect(), key=lambda r: r["archive_date"])
    assert [r["year"] for r in rows] == [2018, 2018, 2019]
    assert rows[0]["specialty_name"] == "Cardiology" and rows[0]["time_bands"] == "0-3 Months"
    assert rows[0]["specialty_hipe"] == 10 and rows[1]["specialty_hipe"] is None
    assert rows[1]["specialty_name"] == "Cardiology" and rows[1]["time_bands"] == "18+ Months"
    assert ip_bad.count() == 1 and ip_bad.first()["_reject_reason"] == "bad archive_date"
    assert "hospital_group" not in ip.columns and not any(c.startswith("_c") for c in ip.columns)
    op, op_bad = read_outpatient_csv(spark, ops)
    assert op_bad.count() == 0 and op.count() == 3
    ages = sorted((r["age_profile"] is None, r["age_profile"]) for r in op.collect())
    assert ages[0] == (False, "") and ages[-1] == (True, None)   # blank-only stays '', empty is null
    dim = read_mapping_csv(spark, mp)
    assert dim.count() == 2


def test_ingest_feeds_reports_and_store(spark):
    _, ips, ops, mp = _fixtures()
    ip, _ = read_inpatient_csv(spark, ips)
    op, _ = read_outpatient_csv(spark, ops)
    wl = WaitingList(ip, op, read_mapping_csv(spark, mp))
    groups = {r["specialty_group"] for r in wl.full().collect()}
    assert groups == {"Heart", "Other"}
    tot = {(r["year"], r["patient_type"]): r["total_patients"] for r in reports.annual_totals(wl).collect()}
    assert tot[(2018, "Outpatient")] == 24 and tot[(2018, "Inpatient")] == 12
    out = os.path.join(tempfile.mkdtemp(prefix="ql-store-"), "fact_inpatient")
    write_fact_store(ip, out)
    back = read_fact_store(spark, out, INPATIENT_SCHEMA)
    one_year = back.filter(F.col("year") == 2019).select("total")
    assert one_year.count() == 1
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan   # year pruned at listing
    assert "ReadSchema: struct<total:int>" in plan                            # only the used column is read
    assert {"year=2018", "year=2019"} <= set(os.listdir(out))


def test_every_damaged_line_is_rejected_with_its_reason(spark):
    d = tempfile.mkdtemp(prefix="ql-csv-")
    good = "31/01/2018,G1,1,10,Cardiology,Inpatient,Adult,16-64,0-3 Months,5"
    path = _write(d, "inpatient 2018.csv", [
        IN_HEADER, good + ",", good, good + ",,more,fields", "31/01/2018,G1,1,10,Cardiology",
        good.replace(",10,", ",ABC,") + ",", good.replace(",5", ",9999999999") + ",", good.replace(",5", ",x") + ",",
        good.replace(",10,", ",,") + ",", '31/01/2018,"G1, north",1,10,Cardiology,Inpatient,Adult,16-64,0-3 Months,6,'])
    again = _write(d, "inpatient 2019.csv", [IN_HEADER, good.replace("2018", "2019") + ","])
    ok, bad = read_inpatient_csv(spark, [path, again])
    assert sorted(r["total"] for r in ok.collect()) == [5, 5, 5, 5, 6]
    assert sorted(r["_reject_reason"] for r in bad.collect()) == [
        "bad specialty_hipe", "bad total", "bad total", "extra fields", "missing fields"]
    assert ok.count() + bad.count() == 10
    plan = ok._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan csv") == 1                # one header, one scan


def test_many_files_with_mixed_headers_in_one_scan(spark):
    import random
    d, rng = tempfile.mkdtemp(prefix="ql-csv-"), random.Random(7)
    names = ["Archive_Date", "Specialty_HIPE", "Specialty_Name", "Case_Type", "Adult_Child", "Age_Profile", "Time_Bands", "Total"]
    paths, lines, want, rejected = [], 0, [], 0
    for f in range(500):
        own = names[:]
        rng.shuffle(own)                                     # an order of columns of its own
        if f % 3 == 0:
            own.remove("Case_Type")
        if f % 5 == 0:
            own[own.index("Specialty_Name")] = "Speciality"
        year = 2000 + f % 20
        rows = []
        for i in range(rng.randint(0, 4)):
            cell = {"Archive_Date": f"{1 + i}/02/{year}", "Specialty_HIPE": str(f), "Specialty_Name": f"Ward {f}, east", "Speciality": f"Ward {f}, east",
                    "Case_Type": "Inpatient", "Adult_Child": "Adult", "Age_Profile": "65+", "Time_Bands": "0-3 Months", "Total": str(f + i)}
            fields = [f'"{cell[c]}"' if "," in cell[c] else cell[c] for c in own]
            damage = rng.choice(["", "", "", "extra", "short"])
            fields = fields + ["x"] if damage == "extra" else fields[:-2] if damage == "short" else fields
            rows.append(",".join(fields) + ("," if f % 7 == 0 else ""))
            # a file whose header ends with a nameless column takes one field more
            if (damage == "extra") or damage == "short":
                rejected += 1
            else:
                want.append((f"Ward {f}, east", f + i, year, None if f % 3 == 0 else "Inpatient"))
        header = ",".join(f" {c} " for c in own) + ("," if f % 7 == 0 else "")
        paths.append(_write(d, f"inpatient {year} part {f}.csv", [header, *rows]))
        lines += len(rows)
    sc = spark.sparkContext
    sc.setJobGroup("mixed headers", "reads 500 files")
    ok, bad = read_inpatient_csv(spark, paths)
    jobs = len(sc.statusTracker().getJobIdsForGroup("mixed headers"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4                                         # two listings and one aggregation, not a job per file
    got = sorted((r["specialty_name"], r["total"], r["year"], r["case_type"]) for r in ok.collect())
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert bad.count() == rejected and len(got) + rejected == lines
    assert ok._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan csv") == 1
