"""Fact tables whose years are replaced in one step.

Every publication writes its rows to folders of its own,
``data/year=<year>/batch=<id>``, and then adds a manifest that names the one
folder that counts for each year. Readers take the latest manifest, so they
see all of a publication or nothing of it, whatever fails on the way; folders
that no manifest names are passed over. A manifest is written aside and
renamed to the next number; the rename fails where that number exists, and
the publisher then starts from the manifest that came first. On HDFS and
similar stores the rename is one step; object stores without such a rename
take one publisher at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


class _Store:
    """The few file operations needed, on whatever store Spark's own paths are."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(self.root).getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)

    def found(self, pattern: str) -> list:
        return [s.getPath() for s in self.fs.globStatus(self.hadoop.Path(f"{self.root}/{pattern}")) or []]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.hadoop.Path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Whether ``name`` is now there with ``text``; False where it was there before."""
        aside = self.hadoop.Path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        there = self.hadoop.Path(f"{self.root}/{name}")
        try:
            self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(
                self.fs.makeQualified(aside), self.fs.makeQualified(there), self.none)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if self.fs.exists(there):
                return False
            raise e
        return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the publications, the latest last."""
    return sorted(int(p.getName().removesuffix(".json")) for p in _Store(spark, root).found("versions/[0-9]*.json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """Year -> batch that counts, as of ``version`` (None: the latest)."""
    there = versions(spark, root)
    if version is None and not there:
        return {}
    if version is not None and version not in there:
        raise ValueError(f"no version {version} of {root}")
    return json.loads(_Store(spark, root).read(f"versions/{there[-1] if version is None else version:012d}.json"))


def publish(rows: DataFrame, root: str, years: Iterable = ()) -> int:
    """Replace the years that ``rows`` bring, and ``years`` also where they bring nothing; the new version.

    Rows are written by the tasks that hold them, as in ``write_fact_store``:
    a year with a large share of all rows does not meet in one task. Null
    years are a year of their own.
    """
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    (rows.withColumn(BATCH, F.lit(batch)).write.mode("append").partitionBy("year", BATCH)
     .parquet(f"{root.rstrip('/')}/data"))
    store = _Store(spark, root)
    brought = {p.getParent().getName().removeprefix("year="): batch for p in store.found(f"data/year=*/{BATCH}={batch}")}
    while True:
        there = versions(spark, root)
        kept = manifest(spark, root, there[-1]) if there else {}
        kept = {y: b for y, b in kept.items() if y not in {str(y) for y in years}} | brought
        version = there[-1] + 1 if there else 1
        if store.write_once(f"versions/{version:012d}.json", json.dumps(kept)):
            return version


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None,
                  years: Iterable | None = None) -> DataFrame:
    """The rows of one version, or of its ``years`` as the manifest names them; filters on ``year`` prune its folders."""
    data = f"{root.rstrip('/')}/data"
    wanted = None if years is None else {str(y) for y in years}
    paths = [f"{data}/year={y}/{BATCH}={b}" for y, b in sorted(manifest(spark, root, version).items())
             if wanted is None or y in wanted]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", data).parquet(*paths).select(*schema.names)
