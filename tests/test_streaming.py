"""Incremental ingest: new files only, restart-safe through the checkpoint."""

import os
import tempfile

from queuelens.sources import snapshots
from queuelens.sources.store import INPATIENT_SCHEMA, read_fact_store
from queuelens.streaming import start_fact_ingest

HEADER = "Archive_Date,Group,Hospital_HIPE,Specialty_HIPE,Specialty_Name,Case_Type,Adult_Child,Age_Profile,Time_Bands,Total"


def _drop(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join([HEADER] + rows) + "\n")


def test_incremental_ingest(spark):
    base = tempfile.mkdtemp(prefix="ql-stream-")
    src, store, ckpt, rej = (os.path.join(base, p) for p in ("in", "store", "ckpt", "rejects"))
    os.makedirs(src)
    _drop(src, "inpatient 2018.csv", ["31/01/2018,G,1,10, Cardiology ,Inpatient,Adult,16-64,18 Months +,5",
                                  "bad,G,1,10,Cardiology,Inpatient,Adult,16-64,0-3 Months,5"])
    q = start_fact_ingest(spark, src, store, ckpt, reject_dir=rej)
    q.awaitTermination(120)
    first = read_fact_store(spark, store, INPATIENT_SCHEMA)
    assert first.count() == 1
    assert first.first()["time_bands"] == "18+ Months" and first.first()["year"] == 2018
    _drop(src, "inpatient 2019.csv", ["28/02/2019,G,1,11,Urology,Day Case,Child,0-15,3-6 Months,7"])
    q = start_fact_ingest(spark, src, store, ckpt, reject_dir=rej)
    q.awaitTermination(120)
    again = read_fact_store(spark, store, INPATIENT_SCHEMA)
    assert again.count() == 2                       # the 2018 file was not read twice
    assert sorted(r["year"] for r in again.collect()) == [2018, 2019]
    assert spark.read.parquet(rej).count() == 1
    # a refreshed year under a new name replaces the year's rows
    _drop(src, "inpatient 2019 r2.csv", ["28/02/2019,G,1,11,Urology,Day Case,Child,0-15,3-6 Months,7",
                                         "31/03/2019,G,1,11,Urology,Day Case,Child,0-15,3-6 Months,9"])
    q = start_fact_ingest(spark, src, store, ckpt, reject_dir=rej)
    q.awaitTermination(120)
    fresh = read_fact_store(spark, store, INPATIENT_SCHEMA).collect()
    assert sorted((r["year"], r["total"]) for r in fresh) == [(2018, 5), (2019, 7), (2019, 9)]


def test_older_file_arriving_later_loses_and_old_rejects_go(spark):
    base = tempfile.mkdtemp(prefix="ql-stream-")
    src, store, ckpt, rej = (os.path.join(base, p) for p in ("in", "store", "ckpt", "rejects"))
    os.makedirs(src)

    def take(name, rows, modified):
        _drop(src, name, rows)
        os.utime(os.path.join(src, name), (modified, modified))
        start_fact_ingest(spark, src, store, ckpt, reject_dir=rej).awaitTermination(120)
        facts = read_fact_store(spark, store, INPATIENT_SCHEMA).collect()
        return sorted((r["year"], r["total"]) for r in facts), spark.read.schema("_reject_reason string, year int").parquet(rej).count()

    good = "28/02/2019,G,1,11,Urology,Day Case,Child,0-15,3-6 Months,"
    assert take("inpatient 2019 r2.csv", [good + "7", "bad," + good + "1"], 2_000_000) == ([(2019, 7)], 1)
    # last modified before the file that was taken: nothing changes, its own reject is not kept either
    assert take("inpatient 2019.csv", [good + "1", "bad," + good + "1", "worse," + good + "1"], 1_000_000) == ([(2019, 7)], 1)
    assert take("inpatient 2018.csv", [good.replace("2019", "2018") + "2"], 500_000) == ([(2018, 2), (2019, 7)], 1)
    # a newer, clean file: the year's old rejects go
    assert take("inpatient 2019 r3.csv", [good + "8", good + "9"], 3_000_000) == ([(2018, 2), (2019, 8), (2019, 9)], 0)


def test_batches_as_snapshots(spark):
    base = tempfile.mkdtemp(prefix="ql-stream-")
    src, store, ckpt, rej = (os.path.join(base, p) for p in ("in", "store", "ckpt", "rejects"))
    os.makedirs(src)
    good = "28/02/2019,G,1,11,Urology,Day Case,Child,0-15,3-6 Months,"
    _drop(src, "inpatient 2019.csv", [good + "7", "bad," + good + "1"])
    _drop(src, "inpatient 2018.csv", [good.replace("2019", "2018") + "2"])
    start_fact_ingest(spark, src, store, ckpt, reject_dir=rej, snapshots=True).awaitTermination(120)
    assert snapshots.versions(spark, store) == [1]              # both years in one step
    _drop(src, "inpatient 2019 r2.csv", [good + "8"])
    start_fact_ingest(spark, src, store, ckpt, reject_dir=rej, snapshots=True).awaitTermination(120)

    def facts(version=None):
        rows = snapshots.read_snapshot(spark, store, INPATIENT_SCHEMA, version).collect()
        return sorted((r["year"], r["total"]) for r in rows)

    assert facts() == [(2018, 2), (2019, 8)] and facts(1) == [(2018, 2), (2019, 7)]
    assert not snapshots.manifest(spark, rej) and snapshots.versions(spark, rej) == [1, 2]
