"""Kept summaries against a full recomputation; only changed years are read."""

import statistics

from pyspark.sql import types as T

from queuelens.sources import maintained as K
from queuelens.sources import snapshots as S

SCHEMA = T.StructType().add("name", T.StringType()).add("total", T.IntegerType()).add("year", T.IntegerType())
CUBE = K.cube(["name"])


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def both(spark, root, state):
    kept = K.read_summary(spark, state, SCHEMA, CUBE)
    whole = CUBE(S.read_snapshot(spark, root, SCHEMA)).select(*kept.columns)
    return sorted(map(str, kept.collect())), sorted(map(str, whole.collect()))


def test_changed_gone_and_null_years(spark, tmp_path):
    root, state = str(tmp_path / "facts"), str(tmp_path / "state")
    assert K.refresh(spark, root, state, SCHEMA, CUBE) == []
    S.publish(facts(spark, ("a", 1, 2018), ("a", 5, 2018), ("b", 2, 2019), ("a", None, 2019), (None, 7, None)), root)
    assert K.refresh(spark, root, state, SCHEMA, CUBE) == ["2018", "2019", K.NO_YEAR]
    assert K.refresh(spark, root, state, SCHEMA, CUBE) == []
    S.publish(facts(spark, ("b", 9, 2019), ("c", 4, 2019)), root)
    read = S.read_snapshot(spark, root, SCHEMA, years=["2019"]).inputFiles()
    assert read and all("year=2019" in f for f in read)
    assert K.refresh(spark, root, state, SCHEMA, CUBE) == ["2019"]
    kept, whole = both(spark, root, state)
    assert kept == whole and len(kept) == 4
    S.publish(facts(spark), root, years=[2018])
    assert K.refresh(spark, root, state, SCHEMA, CUBE) == []
    kept, whole = both(spark, root, state)
    assert kept == whole and len(kept) == 3


def test_years_add_up(spark, tmp_path):
    root, state = str(tmp_path / "facts"), str(tmp_path / "state")
    rows = [("a", 10**9 + i * i % 7, 2018 + i % 3) for i in range(60)] + [("b", 3, 2018)]
    S.publish(facts(spark, *rows), root)
    K.refresh(spark, root, state, SCHEMA, CUBE)
    got = {r["name"]: r for r in K.over(K.read_summary(spark, state, SCHEMA, CUBE), ["name"]).collect()}
    of_a = [t for n, t, _ in rows if n == "a"]
    assert got["a"]["variance"] == statistics.variance(of_a) and got["a"]["total"] == sum(of_a)
    assert got["b"]["variance"] is None and got["b"]["mean"] == 3.0 and got["b"]["records"] == 1


def test_variance_beyond_38_digits(spark):
    n = 10**12
    huge = spark.sql(
        f"SELECT 'a' AS name, {n}L AS records, {n}L AS counted, {n * 10**6}L AS total, "
        f"CAST('{2 * 10**24}' AS DECIMAL(38,0)) AS squares, 0 AS least, 2 AS most")
    (got,) = K.over(huge, ["name"]).collect()
    assert got["mean"] == 1e6 and abs(got["variance"] / 1e12 - 1) < 1e-9
    many = huge.withColumn("squares", (huge["squares"] * 1000).cast("decimal(38,0)"))
    (got,) = K.over(many, ["name"]).collect()
    assert abs(got["variance"] / 1.999e15 - 1) < 1e-9
