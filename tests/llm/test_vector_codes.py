import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from queuelens.llm import vector_codes
from queuelens.llm.vector_codes import assign, compress, pivot_distances, spread_pivots

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _label string, error string"


def brute(rows, parts=8, entries=16, rounds=6, factor=4096):
    kept = [(k, [math.floor(factor * x) for x in v], l) for k, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    raw = {id(r[1]): r for r in kept}
    kept = [(k, v + [0] * (parts * place - len(v)), l) for k, v, l in raw.values()]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[v[p * place:(p + 1) * place] for p in range(parts)] for _, v, _ in kept]
    books = [[v[p * place:(p + 1) * place] for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    sums, out = defaultdict(int), []
    for (k, _, l), v in zip(kept, cut):
        found = [nearest(x, b) for x, b in zip(v, books)]
        error = sum(d for d, _ in found)
        sums[l] += error
        out.append((k, "".join(f"{e:02x}" for _, e in found), error, l))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((k, c, e, sums[l], digest) for k, c, e, l in out), key=str)


def rows_of(n, d, seed=2):
    rng = random.Random(seed)
    rows = [(n - i, [float(np.float32(rng.gauss(0, 1))) for _ in range(d)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(2 * n + i, rows[7][1][:], 1) for i in range(20)] + [(rows[5][0], rows[5][1][:], 3), (None, rows[1][1][:], 1)]
    return rows + [(3 * n, None, 1), (3 * n + 1, [None] * d, 1), (3 * n + 2, [float("nan")] * d, 2), (3 * n + 3, [float("inf")] * d, 2),
                   (3 * n + 4, [0.0] * d, 0), (3 * n + 5, [], 0), (3 * n + 6, [1.0], None)]


def got(table, **how):
    found = compress(table, **how)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize(("n", "d"), [(120, 64), (120, 10), (9, 16), (60, 3)])
def test_against_brute_force(stored, n, d):
    rows = rows_of(n, d)
    table = stored([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    assert got(table) == brute(rows)


def test_other_sizes_and_many_labels(stored, monkeypatch):
    rows = rows_of(80, 12)
    table = stored([(*r, "x", "x", "x") for r in rows], SCHEMA)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)              # sums joined instead of broadcast
    assert got(table, parts=3, entries=5, rounds=2, pivots=2) == brute(rows, parts=3, entries=5, rounds=2)


def test_empty(stored):
    table = stored([(1, None, 1, "x", "x", "x")], SCHEMA)
    assert got(table) == [] and got(table.limit(0)) == []


def test_pivots_prune_without_changing_the_nearest():
    rng = np.random.default_rng(4)
    parts = np.concatenate([rng.integers(-4000, 4000, (3000, 8)), np.zeros((50, 8), np.int64)])
    entries = np.concatenate([parts[:12], parts[:4]])               # equal entries: the lower index wins
    pivots = spread_pivots(entries, 8)
    at, gap, evaluated = assign(parts, pivot_distances(parts, pivots), entries, pivot_distances(entries, pivots))
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (gap == every.min(axis=1)).all()
    assert evaluated < 0.6 * every.size
