import time

from pyspark.sql import functions as F

from queuelens.llm.common import SHUFFLE_CLEANUP, numbered, settle


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rsplit("/", 1)[1] for f in files.split("\n") if "/shuffle_" in f}


def test_settle_leaves_no_shuffle_files(spark):
    """They go once the checkpoint is written, without a garbage collection; the session's own setting stays."""
    kept, before = spark.conf.get(SHUFFLE_CLEANUP, None), shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    got = settle(rows.join(rows.withColumnRenamed("s", "t"), "k"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == kept
    want = {(k, s, s) for k in range(100) for s in [sum(range(k, 5000, 100))]}
    assert {tuple(r) for r in got.collect()} == want == {tuple(r) for r in got.collect()}
    assert rows.count() == 100 and rows.count() == 100


def test_file_numbers_start_no_python_workers(spark, stored):
    """File names reach the plan as a local relation; rows of tuples would be an RDD that Python workers serialise."""
    docs, row = numbered(stored([(i, f"t{i}") for i in range(50)], "doc_id long, text string"))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "RDD" not in plan
    assert docs.select(row).distinct().count() == 50
