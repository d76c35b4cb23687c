"""Nearest neighbours by inner product with forests of hash strings.

A vector's hash string in a tree names the coordinates of its rotation by
size: first the largest in absolute value with its sign, then the next, and
so on, so near vectors share long prefixes. Rows are dealt to shards of
bounded size. A shard keeps one sorted array of strings per tree; a query
descends to its longest matching prefix in every tree, then all trees ascend
together, a symbol at a time, until enough candidates lie under the prefixes.
Candidates are scored exactly, and the shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from queuelens.llm.common import settle

SYMBOLS = 4
BITS = 15                                  # of a symbol: coordinate and sign


def rotations(dimensions: int, trees: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0] for _ in range(trees)])


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows with a coordinate more that makes all equally long, so that angles order inner products."""
    scaled = vectors / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled ** 2).sum(axis=1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def strings(points: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """(point, tree) hash strings, packed into integers with the first symbol on top."""
    out = np.empty((len(points), len(turns)), np.int64)
    names = min(SYMBOLS, points.shape[1])
    for t, turn in enumerate(turns):
        y = points @ turn
        size = np.abs(y)
        code = np.zeros(len(points), np.int64)
        for _ in range(names):
            at = size.argmax(axis=1)
            row = np.arange(len(points))
            code = code << BITS | (2 * at + (y[row, at] > 0))
            size[row, at] = -1.0
        out[:, t] = code << BITS * (SYMBOLS - names)
    return out


class Forest:
    """Sorted arrays of one shard."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(codes.T, self.order, axis=1)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each row of strings the points under its prefixes, which are as long as they
        can be with ``enough`` points; all trees go up together, a symbol at a time."""
        ranges = []
        for depth in range(SYMBOLS, 0, -1):
            cut = BITS * (SYMBOLS - depth)
            low = (queries >> cut) << cut
            lo = np.stack([np.searchsorted(s, low[:, t]) for t, s in enumerate(self.sorted)], axis=1)
            hi = np.stack([np.searchsorted(s, low[:, t] + (1 << cut)) for t, s in enumerate(self.sorted)], axis=1)
            ranges.append((lo, hi, (hi - lo).sum(axis=1)))
        total = self.sorted.shape[1]
        for q in range(len(queries)):
            out = np.arange(total)
            for lo, hi, n in ranges:
                if n[q] >= enough:
                    found = np.zeros(total, bool)
                    found[np.concatenate([o[i:j] for o, i, j in zip(self.order, lo[q], hi[q])])] = True
                    if np.count_nonzero(found) >= enough:
                        out = np.flatnonzero(found)
                        break
            yield out


def usable(vector: str) -> F.Column:
    """Not null, not zero and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def nearest(table: DataFrame, k: int = 20, trees: int = 64, enough: int = 1024, shard_rows: int = 8192,
            query_rows: int = 4096, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for each row whose key is divisible by ``every``.

    query_id, rank from 1, key, score (inner product in double precision of
    the given vectors); never the query's own row; ties to smaller keys.
    Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do those of another length than most; a null key takes no
    part. Equal vectors are searched once and found together, each with its
    k + 1 smallest keys, so copies cost no more than one vector. Rows that
    repeat a key and vector count once. An empty table gives no rows.
    """
    rows = (table.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
            .filter(F.col("_id").isNotNull() & usable("_v")))
    size = rows.agg(F.mode(F.size("_v")).alias("d")).first()["d"]
    longest = rows.filter(F.size("_v") == F.lit(size or 0)).agg(
        F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()["m"]
    longest = float(longest or 1.0) ** 0.5
    turns = rotations((size or 1) + 1, trees)
    rows = rows.filter(F.size("_v") == F.lit(size or 0)).withColumn("_h", F.xxhash64("_v")).distinct()
    same = Window.partitionBy("_h", "_v").orderBy("_id")
    classes = (rows.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1)
               .groupBy("_h", "_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")))     # k + 1 at most
    asked = (rows.filter(F.col("_id") % every == 0).select("_h", "_v", F.col("_id").alias("query_id")))

    @pandas_udf("array<long>")
    def string_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(strings(lifted(np.stack(batch.to_numpy()), longest), turns)))

    @pandas_udf("array<long>")
    def query_string_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            v = np.stack(batch.to_numpy())
            v = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], axis=1)
            yield pd.Series(list(strings(v, turns)))

    index = settle(classes.withColumn("_codes", string_of("_v")))
    queries = settle(asked.select("_h", "_v").distinct().withColumn("_codes", query_string_of("_v")))
    shards = max(1, -(-index.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    points = (index.withColumn("_shard", F.pmod("_h", F.lit(shards)))
              .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    ask = (queries.withColumn("_block", F.pmod("_h", F.lit(blocks)).cast("int"))
           .withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
           .select("_shard", "_block", F.col("_h").alias("q_h"), F.col("_v").alias("q_v"), F.col("_codes").alias("q_codes")))

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            vectors = np.stack(own["_v"].to_numpy())
            forest = Forest(np.stack(own["_codes"].to_numpy()))
            ids = own["_ids"].to_numpy()
            smallest = np.array([i[0] for i in ids])
            found = forest.candidates(np.stack(asking["q_codes"].to_numpy()), enough)
            for h, v, at in zip(asking["q_h"], asking["q_v"], found):
                if len(at) > k + 1:
                    rough = vectors[at] @ v
                    edge = np.partition(rough, -(k + 1))[-(k + 1)]
                    at = at[rough >= edge - 1e-9 * (1.0 + np.abs(rough).max())]
                # component by component, so that rounding does not depend on the place in a shard
                score = (vectors[at] * v).sum(axis=1)
                order = np.lexsort((smallest[at], -score))[:k + 1]
                for a in order:
                    out += [(h, v, int(i), float(score[a])) for i in ids[at[a]]]
        return pd.DataFrame(out, columns=["_h", "_v", "_id", "score"])

    found = (points.groupBy("_shard", "_block").cogroup(ask.groupBy("_shard", "_block"))
             .applyInPandas(search, "_h long, _v array<double>, _id long, score double"))
    found = found.select("_h", F.col("_v").alias("_q"), "_id", "score")
    by = Window.partitionBy("_h", "_q").orderBy(F.desc("score"), "_id")
    best = (found.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k + 1)
            .groupBy("_h", "_q").agg(F.sort_array(F.collect_list(F.struct("_r", "_id", "score"))).alias("_best")))
    others = F.filter("_best", lambda b: b["_id"] != F.col("query_id"))
    return (asked.join(best, (asked["_h"] == best["_h"]) & (asked["_v"] == best["_q"]))
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_p", "_b"))
            .select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_b._id").alias(key),
                    F.col("_b.score").alias("score")))
