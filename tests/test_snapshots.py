"""Years are replaced in one step, or not at all."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.sources import snapshots as S

SCHEMA = T.StructType().add("total", T.IntegerType()).add("year", T.IntegerType())


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def read(spark, root, version=None):
    return sorted(((r.year or 0), r.total) for r in S.read_snapshot(spark, root, SCHEMA, version).collect())


def test_replace_empty_and_old_versions(spark, tmp_path):
    root = str(tmp_path / "s")
    assert read(spark, root) == [] and S.versions(spark, root) == []
    assert S.publish(facts(spark, (1, 2018), (2, 2019), (3, 2019)), root) == 1
    held = S.read_snapshot(spark, root, SCHEMA)
    assert S.publish(facts(spark, (9, 2019), (5, 2020), (6, None)), root) == 2
    assert read(spark, root) == [(0, 6), (2018, 1), (2019, 9), (2020, 5)]
    assert held.count() == 3                                    # a reader keeps the version it began with
    assert S.publish(facts(spark, (7, 2018)), root, years=[2018, 2020]) == 3
    assert read(spark, root) == [(0, 6), (2018, 7), (2019, 9)]
    assert read(spark, root, 1) == [(2018, 1), (2019, 2), (2019, 3)]
    with pytest.raises(ValueError, match="no version 7"):
        S.manifest(spark, root, 7)
    plan = S.read_snapshot(spark, root, SCHEMA).filter("year = 2019")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_failure_between_partitions_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    S.publish(facts(spark, (1, 2018), (2, 2019)), root)
    # 2018 is written by one task, the task of 2019 fails
    broken = (spark.range(0, 2, 1, 2).select(F.col("id").cast("int").alias("total"), (F.col("id") + 2018).cast("int").alias("year"))
              .withColumn("total", F.when(F.col("year") == 2019, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("total"))))
    with pytest.raises(Exception, match="lost"):
        S.publish(broken, root)
    assert read(spark, root) == [(2018, 1), (2019, 2)] and S.versions(spark, root) == [1]


def test_failure_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    S.publish(facts(spark, (1, 2018), (2, 2019)), root)

    def lost(*_):
        raise OSError("lost")
    monkeypatch.setattr(S._Store, "write_once", lost)
    with pytest.raises(OSError):
        S.publish(facts(spark, (8, 2018), (9, 2019)), root)
    monkeypatch.undo()
    assert read(spark, root) == [(2018, 1), (2019, 2)]
    assert S.publish(facts(spark, (3, 2019)), root) == 2 and read(spark, root) == [(2018, 1), (2019, 3)]


def test_a_number_is_taken_once(spark, tmp_path):
    root = str(tmp_path / "s")
    S.publish(facts(spark, (1, 2018)), root)
    store = S._Store(spark, root)
    assert not store.write_once("versions/000000000001.json", "{}") and read(spark, root) == [(2018, 1)]
    both = [threading.Thread(target=S.publish, args=(facts(spark, (y, y)), root)) for y in (2019, 2020)]
    for t in both:
        t.start()
    for t in both:
        t.join(100)
    assert read(spark, root) == [(2018, 1), (2019, 2019), (2020, 2020)] and S.versions(spark, root) == [1, 2, 3]
