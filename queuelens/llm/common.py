"""Helpers shared by the operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.session import ensure_checkpoint_dir


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Once it is written nobody reads the shuffle files behind it; they are removed
    then, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)           # a frame of its own: it takes the setting as it is made
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def utf8(text: str) -> Column:
    """Bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _stored(docs: DataFrame) -> bool:
    """Whether ``docs`` is one stored table, less rows or columns perhaps, that names each row's file and place."""
    plan = getattr(docs, "_jdf", None)
    if plan is None:
        return False
    plan = plan.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select(docs.metadataColumn("_metadata").getField("row_index")).schema  # noqa: B018 - analysis only
    except AnalysisException:
        return False
    return True


def _by_number(path: str) -> list:
    """Sort key of a file name that has part-2 before part-10."""
    return [int(s) if i % 2 else s for i, s in enumerate(re.split(r"([0-9]+)", path))]


def numbered(docs: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``docs`` with a long per row that every read gives alike, and the name of that column.

    In a stored table it is the file's number, in the order of file names, and the row's place in the file; it grows
    in the order in which the table was written, and does not depend on how scans are split. Only the names of the
    files reach the driver, which lists them for each scan anyway. Anything else is numbered once and written to the
    shared folder, and what is returned is read from there.
    """
    row = fresh(docs, name)
    if not _stored(docs):
        return settle(docs.withColumn(row, F.monotonically_increasing_id())), row
    place = docs.metadataColumn("_metadata")
    path, file, number = fresh(docs, "_path"), fresh(docs, "_file"), fresh(docs, "_number")
    names = [r[0] for r in docs.select(place.getField("file_path")).distinct().collect()]
    files = docs.sparkSession.createDataFrame(       # of an Arrow table: rows of tuples would start Python workers
        pa.table([pa.array(sorted(names, key=_by_number), pa.string()), pa.array(range(len(names)), pa.int64())],
                 [file, number]))
    out = docs.select("*", place.getField("file_path").alias(path), place.getField("row_index").alias(row))
    return (out.join(F.broadcast(files), F.col(path) == F.col(file))
            .withColumn(row, F.shiftleft(number, 40) + F.col(row)).drop(path, file, number)), row


def without(docs: DataFrame, row: str, lost: DataFrame) -> DataFrame:
    """``docs`` of ``numbered`` less the rows whose ``row`` is in the one column of ``lost``, and less ``row``."""
    gone = lost.toDF(fresh(docs, "_lost"))
    return docs.join(gone, F.col(row) == F.col(gone.columns[0]), "left_anti").drop(row)


def group_slots(rows: DataFrame, group: str, slot: str, place: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, by the long ``place`` or in partition order.

    ``rows`` must be settled, as its partitions are read more than once. A
    hot group is numbered per input partition, or per 65,536 places, and
    shifted by the counts of earlier ones, so no task holds more of it than that.
    """
    at = (rows.withColumn("_part", F.shiftright(place, 16) if place else F.spark_partition_id())
          .withColumn("_line", F.col(place) if place else F.monotonically_increasing_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (at.groupBy(group, "_part").agg(F.count("*").alias("_n"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_shift"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_line")) - 1
    return (at.withColumn("_in", inside)
            .join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
            .withColumn(slot, (F.col("_in") + F.col("_shift")).cast("long"))
            .drop("_part", "_line", "_in", "_g", "_p", "_shift"))


def most_frequent(counts: DataFrame, count: str, bound: int) -> DataFrame:
    """Rows with the highest counts, whole levels of an eighth of a power of two, at most ``bound`` in all.

    Only the sizes of the levels, at most 512, reach the driver.
    """
    level = F.floor(F.log2(F.col(count).cast("double")) * 8)
    some = counts.filter(F.col(count) > 0)
    sizes = {r["level"]: r["n"] for r in some.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    kept, lowest = 0, None
    for at in sorted(sizes, reverse=True):
        kept += sizes[at]
        if kept > bound:
            break
        lowest = at
    return some.filter(level >= lowest) if lowest is not None else some.filter(F.lit(False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
