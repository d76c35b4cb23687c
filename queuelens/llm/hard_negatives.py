"""Hard negatives by exact integer scores behind one-bit codes.

A row's vector is rotated and replaced by the signs of its components, times
the code-vector alignment (its inner product with the unit vector of the
signs); what is left over is rotated and coded again, a few levels deep. An
anchor's inner product with a code is a sum of popcounts over the bit planes
of the anchor's rounded components. What the codes leave out is at right
angles to the last one, so by Cauchy-Schwarz it changes the score by no more
than the product of two stored lengths. That interval is certain: rows whose
interval cannot reach the result are passed over, and all others are scored
in whole numbers, so the result is that of scoring every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.vectors import floors, packed, products, unpacked, whole, widest
from queuelens.session import ensure_checkpoint_dir

WORD = 64
PLANES = 8                                 # bits of an anchor's rounded components
SLACK = 1e-9                               # of both lengths, above any rounding


class Rotations:
    """One random rotation per level, of vectors filled up with zeros to whole words."""

    def __init__(self, dimensions: int, levels: int, seed: int = 11) -> None:
        self.width = -(-max(1, dimensions) // WORD) * WORD
        rng = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(rng.normal(size=(self.width, self.width)))[0] for _ in range(levels)]
        self.root = np.sqrt(self.width)

    def _wide(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width))
        out[:, :rows.shape[1]] = rows
        return out

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, level, word) bits, (row, level) alignments and (row, level) lengths of what is left over."""
        left, bits, align, rest = self._wide(rows), [], [], []
        for turn in self.turns:
            left = left @ turn
            up = left > 0
            along = np.abs(left).sum(axis=1) / self.root
            left = left - np.where(up, 1.0, -1.0) * (along / self.root)[:, None]
            bits.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
            align.append(along)
            rest.append(np.linalg.norm(left, axis=1))
        return np.stack(bits, axis=1), np.stack(align, axis=1), np.stack(rest, axis=1)

    def queries(self, rows: np.ndarray) -> list[dict]:
        """Per level the rounded anchors as bit planes, with the length of the rounding error."""
        out, turned = [], self._wide(rows)
        for turn in self.turns:
            turned = turned @ turn
            low, step = turned.min(axis=1), np.ptp(turned, axis=1) / ((1 << PLANES) - 1)
            step = np.where(step > 0, step, 1.0)
            steps = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            rounded = low[:, None] + steps * step[:, None]
            planes = [np.packbits((steps >> j & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)
                      for j in range(PLANES)]
            out.append({"low": low, "step": step, "sum": rounded.sum(axis=1), "planes": np.stack(planes, axis=1),
                        "error": np.linalg.norm(turned - rounded, axis=1)})
        return out


class Estimator:
    """Certain intervals of the inner products of one batch of coded rows with anchors."""

    def __init__(self, bits: np.ndarray, align: np.ndarray, rest: np.ndarray, root: float) -> None:
        self.bits, self.align, self.rest, self.root = bits, align, rest, root
        self.ones = np.bitwise_count(bits).sum(axis=2).astype(np.float64)
        self.length = np.sqrt(align[:, -1] ** 2 + rest[:, -1] ** 2 + (align[:, :-1] ** 2).sum(axis=1))

    def level(self, depth: int, rows: np.ndarray, query: list[dict], a: int, length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one level: what it adds to the estimates, to the certain error, and what stays open below it."""
        q = query[depth]
        bits = self.bits[rows, depth]
        inside = np.zeros(len(rows))
        for j in range(PLANES):
            inside += np.bitwise_count(bits & q["planes"][a, j]).sum(axis=1) * float(1 << j)
        inside = q["low"][a] * self.ones[rows, depth] + q["step"][a] * inside
        code = (2 * inside - q["sum"][a]) / self.root
        sure = np.maximum(0.0, np.abs(code) - q["error"][a])
        beside = np.sqrt(np.maximum(0.0, length ** 2 - sure ** 2))
        align = self.align[rows, depth]
        return align * code, align * q["error"][a], self.rest[rows, depth] * beside

    def surviving(self, rows: np.ndarray, query: list[dict], a: int, length: float, keep) -> np.ndarray:
        """``rows`` whose interval ``keep(low, high)`` wants at every level; each level looks at what the last one left."""
        about, error = np.zeros(len(rows)), np.zeros(len(rows))
        for depth in range(self.bits.shape[1]):
            if not len(rows):
                break
            more, wrong, below = self.level(depth, rows, query, a, length)
            about, error = about + more, error + wrong
            reach = error + below + SLACK * (1.0 + length * self.length[rows])
            wanted = keep(about - reach, about + reach)
            rows, about, error = rows[wanted], about[wanted], error[wanted]
        return rows


def kth(values: np.ndarray, k: int) -> float:
    """k-th largest value, minus infinity with fewer."""
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Best:
    """The first ``k`` of each key among all batches of a task."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def floor(self, key: tuple) -> float:
        held = self.held.get(key)
        return float(held[0][-1]) if held is not None and len(held[0]) == self.k else -np.inf

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if key in self.held:
            scores, ids = np.concatenate([self.held[key][0], scores]), np.concatenate([self.held[key][1], ids])
        at = first_of(scores, ids, self.k)
        self.held[key] = scores[at], ids[at]

    def rows(self) -> pd.DataFrame:
        out = [(*key, int(i), int(s)) for key, (scores, ids) in self.held.items() for s, i in zip(scores, ids)]
        return pd.DataFrame(out, columns=["anchor", "window", "id", "score"]).astype("int64")


def coded(table: DataFrame, turn: Rotations, width: int, factor: int) -> DataFrame:
    """Integer rows with codes, alignments and left-over lengths, all as binary values."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = floors(b.column("_v"), factor, width)
            bits, align, rest = turn.codes(rows.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_label"), packed(rows), packed(bits.reshape(len(rows), -1)), packed(align), packed(rest)],
                names=["_id", "_label", "_ints", "_bits", "_align", "_rest"])

    return table.mapInArrow(code, "_id long, _label long, _ints binary, _bits binary, _align binary, _rest binary")


class Block:
    """A block of anchors: what a task needs to look through its rows for them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, turn: Rotations) -> None:
        self.ids, self.labels, self.ints, self.turn = ids, labels, ints, turn
        self.lengths = np.linalg.norm(ints.astype(np.float64), axis=1)

    def batches(self, found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        levels, words, width = len(self.turn.turns), self.turn.width // WORD, self.ints.shape[1]
        for b in found:
            if not b.num_rows:
                continue
            labels = b.column("_label").to_numpy(zero_copy_only=False)
            order = np.argsort(labels, kind="stable")
            bits = unpacked(b.column("_bits"), np.uint64, levels * words).reshape(-1, levels, words)[order]
            yield (b.column("_id").to_numpy(zero_copy_only=False)[order], labels[order],
                   unpacked(b.column("_ints"), np.int64, width)[order],
                   Estimator(bits, unpacked(b.column("_align"), np.float64, levels)[order],
                             unpacked(b.column("_rest"), np.float64, levels)[order], self.turn.root))

    def positives(self, found: Iterator[pa.RecordBatch], count: int) -> pd.DataFrame:
        """The first rows of each anchor's label among the batches."""
        best, query = Best(count), self.turn.queries(self.ints.astype(np.float64))
        for ids, labels, ints, codes in self.batches(found):
            begin, end = np.searchsorted(labels, self.labels), np.searchsorted(labels, self.labels, side="right")
            for a in range(len(self.ids)):
                rows = np.arange(begin[a], end[a])
                rows = rows[ids[rows] != self.ids[a]]
                floor = best.floor((a, 0))
                rows = codes.surviving(rows, query, a, self.lengths[a],
                                       lambda low, high: high >= max(floor, kth(low, count)))
                best.add((a, 0), products(ints[rows], self.ints[a]), ids[rows])
        return best.rows()

    def negatives(self, found: Iterator[pa.RecordBatch], windows: list[list[tuple[int, int]]], count: int) -> pd.DataFrame:
        """For each window (lowest, highest score) of an anchor the first rows of other labels inside it."""
        best, query = Best(count), self.turn.queries(self.ints.astype(np.float64))
        for ids, labels, ints, codes in self.batches(found):
            begin, end = np.searchsorted(labels, self.labels), np.searchsorted(labels, self.labels, side="right")
            for a in range(len(self.ids)):
                if not windows[a]:
                    continue
                rows = np.concatenate([np.arange(begin[a]), np.arange(end[a], len(labels))])

                def keep(low: np.ndarray, high: np.ndarray, a: int = a) -> np.ndarray:
                    wanted = np.zeros(len(low), bool)
                    for w, (bottom, top) in enumerate(windows[a]):
                        inside = low[(low >= bottom) & (high <= top)]
                        wanted |= (low <= top) & (high >= max(bottom, best.floor((a, w)), kth(inside, count)))
                    return wanted

                rows = codes.surviving(rows, query, a, self.lengths[a], keep)
                score = products(ints[rows], self.ints[a])
                for w, (bottom, top) in enumerate(windows[a]):
                    inside = (score >= bottom) & (score <= top)
                    best.add((a, w), score[inside], ids[rows][inside])
        return best.rows()


def merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` per anchor and window of what the tasks found, with their rank."""
    by = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50,
                   factor: int = 256, levels: int = 4, block_rows: int = 16384, key: str = "vec_id",
                   vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose key is divisible by ``every``. An anchor's
    positives are its first ``positives`` other rows of its label by integer
    inner product (higher first, ties by smaller key); for each come the first
    ``negatives`` rows of other labels that score ``low`` to ``high`` percent
    of it. Components are floor(``factor`` * x); a vector shorter than the
    longest goes on with zeros. Rows with a null label, vector, component, a
    non-finite component or a null key take no part; zero vectors do. Rows
    that repeat key, label and vector count once, and a row of the anchor's
    own key is never its positive. An empty table gives no rows; further
    columns are not read. Components saturate at 2^62 and scores at a long's ends.

    Rows are looked through where they lie, once for positives and once for
    negatives, for every block of ``block_rows`` anchors or about as many. A
    block, its positives and its windows are the only things that travel to
    all tasks; a task keeps the best few per anchor and window. Each block's
    result is a folder of its own in the shared one.
    """
    spark = table.sparkSession
    rows = (table.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"),
                         F.col(vector).cast("array<double>").alias("_v"))
            .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & whole(F.col("_v"))).distinct())
    _, width = widest(rows, "_v")
    width = max(1, width)
    turn = Rotations(width, levels)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hard-negatives-{uuid.uuid4().hex}"
    coded(rows, turn, width, factor).write.parquet(f"{folder}/rows")
    index = spark.read.parquet(f"{folder}/rows")
    anchors = index.filter(F.col("_id") % every == 0).select("_id", "_label", "_ints")
    blocks = -(-anchors.count() // block_rows)
    shape = "anchor long, window long, id long, score long"
    parts = []
    for number in range(blocks):
        own = sorted(anchors.filter(F.pmod(F.xxhash64("_id", "_ints"), F.lit(blocks)) == number).collect())
        if not own:
            continue
        ints = np.frombuffer(b"".join(bytes(r["_ints"]) for r in own), np.int64).reshape(len(own), width)
        block = Block(np.array([r["_id"] for r in own]), np.array([r["_label"] for r in own]), ints, turn)

        def find_positives(found: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pandas(block.positives(found, positives), preserve_index=False)

        first = merged(index.mapInArrow(find_positives, shape), positives).collect()    # a few rows per anchor
        windows: list[list[tuple[int, int]]] = [[] for _ in own]
        pairs = []
        for r in sorted(first, key=lambda r: (r["anchor"], r["rank"])):
            bottom, top = -(-low * r["score"] // 100), high * r["score"] // 100
            if bottom <= top:
                pairs.append((r["anchor"], len(windows[r["anchor"]]), own[r["anchor"]]["_id"], r["id"], r["score"]))
                windows[r["anchor"]].append((bottom, top))

        def find_negatives(found: Iterator[pa.RecordBatch], block=block, known=windows) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pandas(block.negatives(found, known, negatives), preserve_index=False)

        asked = spark.createDataFrame(pairs, "_anchor long, _window long, anchor_id long, positive_id long, positive_score long")
        (merged(index.mapInArrow(find_negatives, shape), negatives)
         .join(F.broadcast(asked), (F.col("anchor") == F.col("_anchor")) & (F.col("window") == F.col("_window")))
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score"))
         .write.parquet(f"{folder}/negatives/block={number}"))
        parts.append(number)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    return spark.read.parquet(f"{folder}/negatives").drop("block")
