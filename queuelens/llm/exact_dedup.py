"""Exact duplicates with the frequent texts split off.

A Misra-Gries style frequent-items sketch (Spark's ``approx_top_k``, bounded
counters, merged across tasks) proposes frequent digests. Their exact counts
are taken next; the verified ones, at most ``heavy`` by arithmetic, are
broadcast and their rows are resolved without a shuffle. All other digests
take the ordinary shuffle, where no group holds more than 1/heavy of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.common import numbered, settle, utf8, without


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", line: str | None = None) -> DataFrame:
    """_key, _line, _digest; column ``line`` names the row where ids must hold for another read of ``docs``."""
    return docs.select(F.col(key).alias("_key"),
                       (F.col(line) if line else F.monotonically_increasing_id()).alias("_line"),
                       F.sha2(utf8(text), 256).alias("_digest"))


def heavy_winners(rows: DataFrame, heavy: int = 512) -> DataFrame:
    """(digest, best row, exact count) of the digests that hold 1/heavy of all rows or more."""
    tracked = 1 << (16 * heavy - 1).bit_length()
    proposed = (rows.agg(F.expr(f"approx_top_k(_digest, {4 * heavy}, {tracked})").alias("t"),
                         F.count("*").alias("_all"))
                .select(F.explode("t.item").alias("_digest"), "_all"))
    return (rows.join(F.broadcast(proposed), "_digest")      # at most 4 * heavy rows
            .groupBy("_digest")
            .agg(F.max(F.struct("_key", "_line")).alias("_best"), F.count("*").alias("_n"),
                 F.max("_all").alias("_all"))
            .filter((F.col("_n") * heavy >= F.col("_all")) & (F.col("_n") > 1))
            .select("_digest", "_best", "_n"))


def resolve(rows: DataFrame, heavy: int = 512) -> DataFrame:
    """``digests`` rows plus _best (struct of the row that stays) and _n."""
    rows = settle(rows)
    winners = settle(heavy_winners(rows, heavy))
    frequent = rows.join(F.broadcast(winners), "_digest")                    # at most `heavy` rows
    same = Window.partitionBy("_digest")
    rest = (rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
            .withColumn("_best", F.max(F.struct("_key", "_line")).over(same))
            .withColumn("_n", F.count("*").over(same)))
    return frequent.unionByName(rest)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = 512) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the largest key stays; a null
    key loses to any other; of rows that repeat the largest key exactly one
    is kept. An empty table gives no rows; further columns are not read.
    """
    return resolve(digests(docs, key, text), heavy).select(
        F.col("_key").alias(key), F.col("_best._key").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        (F.col("_best._line") == F.col("_line")).alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = 512) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` does not keep."""
    docs, line = numbered(docs, "_line")
    found = resolve(digests(docs, key, text, line), heavy)
    return without(docs, line, found.filter(F.col("_best._line") != F.col("_line")).select("_line"))
