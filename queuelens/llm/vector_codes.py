"""Product codes of integer vectors, trained with pivots.

Vectors are cut into equal parts; every part position has a codebook that
Lloyd rounds refine. The distances of all parts to a few fixed pivots are
computed once. In each round the pivots' distances to the entries give lower
bounds (the difference of two distances to a pivot cannot exceed the distance
itself); entries are tried in the order of their bounds, by exact integer
distances, until the next bound is beyond the best one found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import settle
from queuelens.llm.vectors import LONG_MAX, floors, largest, packed, squares, unpacked, whole, widest

FEW_LABELS = 1 << 16                       # sums of so many labels at most are broadcast


def spread_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """The first entry and then, each time, the one farthest from all taken."""
    taken = [0]
    near = squares(entries, entries[0]).astype(float)
    while len(taken) < min(pivots, len(entries)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, squares(entries, entries[taken[-1]]))
    return entries[taken]


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(row, pivot) distances."""
    return np.sqrt(np.stack([squares(parts, p) for p in pivots], axis=1).astype(np.float64))


def assign(parts: np.ndarray, near: np.ndarray, entries: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part (ties to the lower index), its squared distance and the number of evaluations.

    ``near`` holds the parts' and ``far`` the entries' distances to the pivots.
    """
    bound = np.abs(near[:, None, :] - far[None, :, :]).max(axis=2)
    order = np.argsort(bound, axis=1, kind="stable")
    lower = np.take_along_axis(bound, order, axis=1)
    # rounding must never prune: a bound counts less than its own error
    lower = np.maximum(0.0, lower - 1e-9 * (near.max(axis=1) + far.max() + 1.0)[:, None])
    best = np.full(len(parts), LONG_MAX, np.int64)
    at = np.full(len(parts), len(entries), np.int64)
    open_ = np.arange(len(parts))
    evaluated = 0
    for j in range(len(entries)):
        if j:
            open_ = open_[lower[open_, j] ** 2 <= best[open_].astype(np.float64) * (1 + 1e-9)]
        if not len(open_):
            break
        tried = order[open_, j]
        gap = squares(parts[open_], entries[tried])
        evaluated += len(open_)
        better = (gap < best[open_]) | ((gap == best[open_]) & (tried < at[open_]))
        best[open_[better]], at[open_[better]] = gap[better], tried[better]
    return at, best, evaluated


class Codebooks:
    """Entries of all part positions with the pivots they are measured against."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray) -> None:
        self.entries, self.pivots = entries, pivots                 # (part, entry, place), (part, pivot, place)
        self.far = [pivot_distances(e, p) for e, p in zip(entries, pivots)]

    def encode(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, part) indexes and squared distances, and the number of evaluations."""
        count, _, place = self.entries.shape
        done = [assign(rows[:, p * place:(p + 1) * place], near[:, p], self.entries[p], self.far[p]) for p in range(count)]
        return np.stack([d[0] for d in done], axis=1), np.stack([d[1] for d in done], axis=1), sum(d[2] for d in done)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def stored_parts(kept: DataFrame, width: int, pivots: np.ndarray, factor: int) -> DataFrame:
    """Integer rows and their parts' distances to the pivots, computed this once and written to the shared folder."""
    parts, _, place = pivots.shape

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = floors(b.column("_v"), factor, width)
            near = np.stack([pivot_distances(rows[:, p * place:(p + 1) * place], pivots[p]) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_label"), packed(rows), packed(near.reshape(len(rows), -1))],
                names=["_id", "_label", "_ints", "_near"])

    types = dict(kept.dtypes)
    return settle(kept.mapInArrow(prepare, f"_id {types['_id']}, _label {types['_label']}, _ints binary, _near binary"))


def refine(rows: DataFrame, width: int, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry to the floor of its parts' mean."""
    parts, count, place = books.entries.shape
    pivots = books.pivots.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, count, place), object)
        seen = np.zeros((parts, count), np.int64)
        for b in batches:
            ints = unpacked(b.column("_ints"), np.int64, width)
            near = unpacked(b.column("_near"), np.float64, parts * pivots).reshape(-1, parts, pivots)
            wide = largest(ints) * max(1, len(ints)) > LONG_MAX
            for p, at in enumerate(books.encode(ints, near)[0].T):
                own = ints[:, p * place:(p + 1) * place]
                own = own.astype(object) if wide else own
                for e in np.unique(at):
                    total[p, e] += own[at == e].sum(axis=0)
                    seen[p, e] += np.count_nonzero(at == e)
        used = [(p, e, i) for p, e in np.argwhere(seen) for i in range(place)]
        # text, as a sum may be longer than a long
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _, _ in used], pa.int32()), "entry": pa.array([e for _, e, _ in used], pa.int32()),
            "place": pa.array([i for _, _, i in used], pa.int32()),
            "total": pa.array([str(total[u]) for u in used], pa.string()),
            "n": pa.array([int(seen[p, e]) for p, e, _ in used], pa.int64())})

    found = (rows.select("_ints", "_near").mapInArrow(sums, "part int, entry int, place int, total string, n long")
             .groupBy("part", "entry", "place")
             .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())
    entries = books.entries.copy()
    for r in found:                                       # a row per component of the codebooks
        entries[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(entries, books.pivots)


def compress(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, pivots: int = 8, factor: int = 4096,
             key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector kept: ``key``, code, error, label_error and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped;
    empty and zero vectors are kept. Vectors shorter than the longest, or than
    the next multiple of ``parts``, go on with zeros. The codebooks start from
    the rows with the smallest keys (null keys last, equal keys by vector);
    with fewer rows than ``entries`` they have as many entries as there are
    rows. Repeated rows count each; null labels are one group; an empty table
    gives no rows; further columns are not read. Components saturate at 2^62
    and errors at the largest long.

    The driver holds the codebooks and, per round, a row per component of
    them. Errors are summed per label before they move; the sums are
    broadcast if there are at most 65,536 labels and joined otherwise.
    """
    kept = table.select(F.col(key).alias("_id"), F.col(label).alias("_label"),
                        F.col(vector).cast("array<double>").alias("_v")).filter(whole(F.col("_v")))
    count, longest = widest(kept, "_v")
    place = max(1, -(-longest // parts))
    start = kept.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    if not count:
        return kept.select(F.col("_id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    first = floors(pa.array([r["_v"] for r in start], pa.list_(pa.float64())), factor, parts * place)
    first = first.reshape(len(start), parts, place).transpose(1, 0, 2)
    books = Codebooks(first, np.stack([spread_pivots(e, pivots) for e in first]))
    rows = stored_parts(kept, parts * place, books.pivots, factor)
    for _ in range(rounds):
        books = refine(rows, parts * place, books)

    taken, pivot_count = books.pivots.shape[0], books.pivots.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = unpacked(b.column("_near"), np.float64, taken * pivot_count).reshape(-1, taken, pivot_count)
            at, gap, _ = books.encode(unpacked(b.column("_ints"), np.int64, parts * place), near)
            error = gap.sum(axis=1) if largest(gap) * parts <= LONG_MAX else \
                np.minimum(gap.astype(object).sum(axis=1), LONG_MAX).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_label"), pa.array(["".join(f"{i:02x}" for i in r) for r in at], pa.string()),
                 pa.array(error, pa.int64())], names=["_id", "_label", "code", "error"])

    types = dict(rows.dtypes)
    coded = settle(rows.mapInArrow(encode, f"_id {types['_id']}, _label {types['_label']}, code string, error long"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = settle(coded.groupBy(F.col("_label").alias("_same")).agg(total.alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return (coded.join(sums, F.col("_label").eqNullSafe(F.col("_same")))
            .select(F.col("_id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")))
