"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. Block k of a source with weight w may start
at fluid time (k-1)/w and is due at k/w; earliest deadline first among the
released blocks then keeps every source within one block of its fluid share.
When a source runs out, the others share its weight in proportion, which
only bends the time axis: ``_clock`` maps the common progress to real slots.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import fresh, group_slots, numbered, settle

_EPS = 1e-6


def _clock(blocks: list[int], weights: list[float]):
    """Slots used up when every running source has progressed to ``v`` = blocks done / weight."""
    ends = sorted((b / w, b, w) for b, w in zip(blocks, weights))
    at = [e[0] for e in ends]
    done, running = [0.0], [math.fsum(weights)]
    for _, b, w in ends:
        done.append(done[-1] + b)
        running.append(running[-1] - w)

    def clock(v: float) -> float:
        i = bisect_right(at, v)
        return done[i] + v * max(running[i], 0.0)

    return clock


def windows(blocks: list[int], weights: list[float]):
    """Function (source index, block from 1) -> (release slot, deadline slot)."""
    clock = _clock(blocks, weights)

    def window(s: int, k: int) -> tuple[int, int]:
        return (math.floor(clock((k - 1) / weights[s]) + _EPS), math.ceil(clock(k / weights[s]) - _EPS))

    return window


def edf(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source index, block from 1) in slot order; memory is one entry per source."""
    window = windows(blocks, weights)
    waiting, ready = [], []
    for s in range(len(blocks)):
        if blocks[s]:
            r, d = window(s, 1)
            heapq.heappush(waiting, (r, d, s, 1))
    slot = 0
    while waiting or ready:
        while waiting and (waiting[0][0] <= slot or not ready):
            r, d, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (d, r, s, k))
        _, _, s, k = heapq.heappop(ready)
        yield s, k
        slot += 1
        if k < blocks[s]:
            r, d = window(s, k + 1)
            heapq.heappush(waiting, (r, d, s, k + 1))


def _target(counts: DataFrame, weights: Mapping[str, float] | None, power: float) -> DataFrame:
    """_src, _rows, _w: given weights, or row counts to ``power`` for sources without one."""
    natural = F.pow(F.col("_rows").cast("double"), F.lit(float(power)))
    if not weights:
        return counts.withColumn("_w", natural)
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive")
    given = counts.sparkSession.createDataFrame(
        [("s" + str(s), float(w)) for s, w in weights.items()], "_src string, _given double")
    return (counts.join(given, "_src", "left")
            .withColumn("_w", F.coalesce("_given", natural)).drop("_given"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, block: int = 64,
        source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``) with its place in the mixture.

    Adds mix_source, mix_block (from 0), mix_slot (the block's turn) and
    mix_position (gapless from 0 over all rows). Nothing is dropped or
    repeated: as sources run out the rest go on in proportion. Weights default
    to row counts raised to ``power``. A null source is a source of its own;
    repeated rows each have a place; an empty table gives no rows.

    The schedule is one row per block; the task that makes it keeps one heap
    entry per source and streams the blocks, so ``block`` sets its length.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = settle(docs.select(src.alias("_src"), *(F.col(c).alias(f"_k_{c}") for c in keep)))
    placed = (group_slots(rows, "_src", "_i")
              .withColumn("_k", F.floor(F.col("_i") / block).cast("long"))
              .withColumn("_o", F.col("_i") % block))
    per_source = _target(rows.groupBy("_src").agg(F.count("*").alias("_rows")), weights, power)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat([b for b in batches] or [pd.DataFrame({"_src": [], "_rows": [], "_w": []})])
        table = table.sort_values("_src")
        names, sizes = table["_src"].tolist(), [int(n) for n in table["_rows"]]
        total = math.fsum(table["_w"])
        counts = [-(-n // block) for n in sizes]
        out, start = [], 0
        for slot, (s, k) in enumerate(edf(counts, [w / total for w in table["_w"]])):
            out.append((names[s], k - 1, slot, start))
            start += min(block, sizes[s] - (k - 1) * block)
            if len(out) == 50_000:
                yield pd.DataFrame(out, columns=["_src", "_k", "_slot", "_start"])
                out = []
        yield pd.DataFrame(out, columns=["_src", "_k", "_slot", "_start"])

    turns = (per_source.coalesce(1)
             .mapInPandas(plan, "_src string, _k long, _slot long, _start long"))
    return (placed.join(turns, ["_src", "_k"])
            .select(*(F.col(f"_k_{c}").alias(c) for c in keep),
                    F.when(F.col("_src") != "n", F.expr("substring(_src, 2)")).alias("mix_source"),
                    F.col("_k").alias("mix_block"), F.col("_slot").alias("mix_slot"),
                    (F.col("_start") + F.col("_o")).alias("mix_position")))


def mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, block: int = 64,
                source: str = "source") -> DataFrame:
    """``docs`` with the same columns and rows, stored in the order of the mixture."""
    columns, place, at = docs.columns, fresh(docs, "_place"), fresh(docs, "_at")
    docs, row = numbered(docs)
    order = mix(docs, weights, power, block, source, keep=(row,))
    order = order.select(F.col(row).alias(at), F.col("mix_position").alias(place))
    return (docs.join(order, F.col(row) == F.col(at))
            .repartitionByRange(place).sortWithinPartitions(place).select(*columns))
