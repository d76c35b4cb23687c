"""Incremental ingest of newly arriving snapshot files.

A file holds one whole year, named in its file name. A file-source stream
picks up file names it has not seen; each micro-batch goes through the same
cleaning expressions as the batch reader and replaces the years it brings in
the year-partitioned Parquet store. So a refreshed year is supplied under a
new name (say ``inpatient 2020 r2.csv``): it takes the place of the earlier
file's rows and neither is lost nor counted twice. A file rewritten under a
name that was read before is not read again. Of several files for one year
the one modified last counts, in whichever batch each arrives: the version
that every year was last taken from is kept beside the stream's checkpoint,
and an older file that arrives later changes nothing. A refreshed year's old
rows and rejects go, also where the new file has none. A batch that is
replayed after a failure starts from the versions before it and so rewrites
exactly its own years.

Trigger ``availableNow`` processes everything that is there and stops,
which suits a scheduled job; a processing-time trigger keeps it running.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from queuelens.sources.csv_ingest import REJECT_REASON, clean_facts, read_raw
from queuelens.sources.snapshots import publish

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])
INPATIENT_COLUMNS = ["archive_date", "specialty_hipe", "specialty_name", "case_type", "adult_child",
                     "age_profile", "time_bands", "total", "year"]


# A file source passes over files much older than the newest one it has
# seen; the file of an early year may well be.
MAX_FILE_AGE = "36500d"
VERSIONS = "year string, modified timestamp, path string"


def _versions_before(spark: SparkSession, folder: str, batch_id: int) -> dict[str, tuple]:
    """year -> (modified, path) as the last batch before ``batch_id`` left it; a row per year."""
    try:
        kept = spark.read.schema(f"{VERSIONS}, batch long").parquet(folder).filter(F.col("batch") < batch_id)
    except AnalysisException:                                  # the first batch: no folder yet
        return {}
    last = kept.agg(F.max("batch").alias("b")).first()["b"]
    rows = kept.filter(F.col("batch") == last).collect() if last is not None else []
    return {r["year"]: (r["modified"], r["path"]) for r in rows}


def _drop_years(spark: SparkSession, folder: str, years: list[str]) -> None:
    """Remove the partitions of ``years``; what comes in their place may be empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for year in years:
        part = path(f"{folder}/year={year}")
        part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)


def start_fact_ingest(spark: SparkSession, source_dir: str, store_dir: str, checkpoint_dir: str,
                      with_case_type: bool = True, available_now: bool = True,
                      reject_dir: str | None = None, pattern: str = "*.csv",
                      files_per_batch: int = 16, snapshots: bool = False) -> StreamingQuery:
    """Stream yearly CSV files from ``source_dir`` into ``store_dir``.

    The file stream only tracks which files are new (the ``binaryFile``
    source with the content column pruned away); each micro-batch then reads
    its new files with the batch CSV reader, so per-file header variants are
    handled exactly as in batch ingest. Only the list of new file paths
    reaches the driver. With ``snapshots`` the facts, and likewise the rejects,
    of all years of a batch change in one step, and are read with
    ``sources.snapshots.read_snapshot``.
    """
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
             .option("maxFileAge", MAX_FILE_AGE)
             .load(source_dir).select("path", "modificationTime"))
    keep = list(INPATIENT_COLUMNS)
    if not with_case_type:
        keep.remove("case_type")

    versions = f"{checkpoint_dir.rstrip('/')}/years"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        latest: dict[str, tuple] = {}
        for r in batch.collect():                        # files_per_batch rows at most
            found = re.search(r"\d{4}", unquote(r["path"].rsplit("/", 1)[-1]))
            year = found.group(0) if found else r["path"]
            latest[year] = max(latest.get(year, (r["modificationTime"], r["path"])), (r["modificationTime"], r["path"]))
        known = _versions_before(spark, versions, batch_id)
        latest = {y: v for y, v in latest.items() if y not in known or v > known[y]}
        if not latest:
            return
        cleaned = clean_facts(read_raw(spark, [p for _, p in latest.values()]))
        parts = [(store_dir, cleaned.filter(F.col(REJECT_REASON).isNull()).select(*keep))]
        if reject_dir:
            parts.append((reject_dir, cleaned.filter(F.col(REJECT_REASON).isNotNull())))
        for folder, rows in parts:
            if snapshots:
                publish(rows, folder, [y for y in latest if y.isdecimal()])
                continue
            _drop_years(spark, folder, [y for y in latest if y.isdecimal()])
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("year").parquet(folder))
        now = [(y, *v) for y, v in (known | latest).items()]
        spark.createDataFrame(now, VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{versions}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
