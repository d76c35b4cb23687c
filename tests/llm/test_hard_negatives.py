import math
import random

import numpy as np
import pytest

from queuelens.llm.hard_negatives import Block, Estimator, Rotations, hard_negatives
from queuelens.llm.vectors import floors, products, squares

SCHEMA = "vec_id long, embedding array<float>, label int, score string, _id string, anchor_id string"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50, factor=256):
    kept = set()
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.add((key, label, tuple(math.floor(factor * x) for x in vector)))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        score = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in kept if r is not a]
        own = sorted(s for s in score if s[2] == a[1] and s[1] != a[0])[:positives]
        for p in own:
            hard = sorted(s for s in score if s[2] != a[1] and low * -p[0] <= 100 * -s[0] <= high * -p[0])[:negatives]
            out += [(a[0], p[1], i + 1, n[1], -p[0], -n[0]) for i, n in enumerate(hard)]
    return sorted(out)


def rows_of(n=400, d=10, seed=5):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(d)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[150][1], 1) for i in range(40)] + [rows[100]] * 3 + [(700, [0.0] * d, 0), (750, [], 1), (800, [1.5] * 3, 2)]
    return rows + [(850, None, 1), (900, [None] * d, 1), (950, [float("nan")] * d, 2), (1000, [float("inf")] + [0.0] * (d - 1), 0),
                   (1050, rows[0][1], None), (None, rows[1][1], 0), (1100, rows[3][1], 5), (1150, [float(-x) for x in rows[3][1]], 5)]


def wide(rows):
    return [(*r, "x", "x", "x") for r in rows]


@pytest.mark.parametrize("d", [1, 10, 70])
def test_against_brute_force(stored, d):
    rows = rows_of(250, d)
    got = hard_negatives(stored(wide(rows), SCHEMA).repartition(5))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_blocks_and_limits(stored):
    rows = rows_of(300)
    table = stored(wide(rows), SCHEMA)
    for how in ({"block_rows": 3}, {"every": 10, "positives": 9, "negatives": 2}, {"levels": 1}, {"positives": 1000, "every": 100}):
        got = sorted(map(tuple, hard_negatives(table, **how).collect()))
        assert got == brute(rows, **{k: v for k, v in how.items() if k not in ("block_rows", "levels")})


def test_nothing_to_find(stored):
    table = stored(wide(rows_of(200)), SCHEMA)
    assert hard_negatives(table.limit(0)).collect() == []
    assert hard_negatives(table.filter("vec_id % 50 <> 0")).collect() == []
    assert hard_negatives(table.filter("label = 0")).collect() == []


def test_intervals_are_certain_and_prune():
    rng = np.random.default_rng(1)
    rows, asked = rng.integers(-300, 300, (4000, 64)), rng.integers(-300, 300, (20, 64))
    turn = Rotations(64, 4)
    codes, query = Estimator(*turn.codes(rows.astype(float)), turn.root), turn.queries(asked.astype(float))
    left = 0
    for a in range(20):
        exact = rows @ asked[a]

        def check(low, high, exact=exact):
            if len(low) == len(exact):
                assert (low <= exact).all() and (exact <= high).all()
            return np.ones(len(low), bool)

        length = float(np.linalg.norm(asked[a]))
        codes.surviving(np.arange(4000), query, a, length, check)
        edge = float(np.sort(exact)[-5])
        kept = codes.surviving(np.arange(4000), query, a, length, lambda low, high, edge=edge: high >= edge)
        assert set(np.flatnonzero(exact >= edge)) <= set(kept)
        left += len(kept)
    assert left < 0.1 * 20 * 4000


def test_whole_numbers_beyond_a_long():
    import pyarrow as pa
    big = floors(pa.array([[1e300, -1e300], [1.0]], pa.list_(pa.float64())), 256, 2)
    assert big[1].tolist() == [256, 0] and abs(int(big[0, 0])) <= 1 << 62 and int(big[0, 1]) == -(1 << 62)
    assert products(big, big[0]).tolist()[0] == (1 << 63) - 1
    assert squares(big, -big[0]).tolist()[0] == (1 << 63) - 1
    assert Block(np.zeros(0, int), np.zeros(0, int), np.zeros((0, 2), int), Rotations(2, 1)).positives([], 5).empty
