"""Packing into optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import group_slots, numbered, settle

WORD = r"[^\x20\x09-\x0D]+"


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of ``lengths`` with the least padding in total.

    best[k][j] = min over i of best[k-1][i] + length[j-1] * (rows in i..j-1);
    what the rows hold themselves is the same for any choice and left out.
    For one j the terms are lines over the length, whose slopes fall with i,
    so the lowest line only moves on as the length grows and a round takes
    time in proportion to the lengths. All numbers are whole and exact. Of
    equal choices the one with fewer buckets, then the smallest i, is taken.
    """
    h = len(lengths)
    if h == 0:
        return []
    edges, rows = [int(e) for e in lengths], [0]
    for c in counts:
        rows.append(rows[-1] + int(c))
    best = [0] + [e * r for e, r in zip(edges, rows[1:])]
    cuts = [np.zeros(h + 1, np.int32)]
    for _ in range(1, min(buckets, h)):
        now, cut = best.copy(), np.full(h + 1, -1, np.int32)
        lines, first = [], 0                                   # i of the lines that are lowest somewhere
        for j, e in enumerate(edges, 1):
            i = j - 1
            while len(lines) - first >= 2:
                a, b = lines[-2], lines[-1]
                if (best[i] - best[b]) * (rows[b] - rows[a]) > (best[b] - best[a]) * (rows[i] - rows[b]):
                    break
                lines.pop()                                    # nowhere below both its neighbours
            lines.append(i)
            while first + 1 < len(lines) and (best[lines[first + 1]] - e * rows[lines[first + 1]]
                                              < best[lines[first]] - e * rows[lines[first]]):
                first += 1
            i = lines[first]
            cost = best[i] + e * (rows[j] - rows[i])
            if cost < now[j]:
                now[j], cut[j] = cost, i
        best = now
        cuts.append(cut)
    bounds, j, k = [], h, len(cuts) - 1
    while j > 0:
        while cuts[k][j] < 0:                # as good with a bucket fewer
            k -= 1
        bounds.append(edges[j - 1])
        j = int(cuts[k][j])
        k = max(k - 1, 0)
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16384, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Every row with its length bucket and its batch there.

    Length is the number of words between ASCII white space (null or empty
    text: 0 words, padded like one). The bounds are those with the least
    padding of all, from the histogram of all lengths, which is gathered on the
    driver: d distinct lengths take at least d * d / 2 words, so 10^13 words
    have 4.5 million at most (two longs each). A batch holds as many rows as
    fit ``budget`` padded tokens, at least one, so a text over the budget has a
    batch to itself. The batches of a bucket take its rows in the order in
    which the table was written, however its scan is split. Ties and repeated
    rows are packed one by one, very long texts are counted whole; an empty
    table gives no rows; other columns, whatever their names, are left out.
    """
    if buckets < 1 or budget < 1:
        raise ValueError("buckets and budget must be at least 1")
    n = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows, at = numbered(docs.select(F.col(key).alias("_key"), n.alias("n_tokens")))
    rows = settle(rows)
    seen = rows.groupBy(F.greatest(F.col("n_tokens"), F.lit(1)).alias("length")).agg(F.count("*").alias("n")).orderBy("length").toArrow()
    bounds = best_bounds(seen["length"].to_numpy(), seen["n"].to_numpy(), buckets)
    place = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bounds))):
        place = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(place)
    width = F.element_at(F.array(*(F.lit(b) for b in bounds or [1])).cast("array<bigint>"), F.col("bucket") + 1)
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return (group_slots(rows.withColumn("bucket", place), "bucket", "_slot", at)
            .withColumn("bucket_len", width)
            .withColumn("batch", F.floor(F.col("_slot") / fit).cast("long"))
            .withColumn("batch_row", (F.col("_slot") % fit).cast("int"))
            .select(F.col("_key").alias(key), "n_tokens", "bucket", "bucket_len", "batch", "batch_row",
                    (F.col("bucket_len") - F.col("n_tokens")).alias("padding")))
