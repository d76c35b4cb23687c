import numpy as np

from queuelens.llm.ann import SYMBOLS, Forest, lifted, nearest, rotations, strings

SCHEMA = "vec_id long, embedding array<float>, label int, _h string, query_id string"


def brute(rows, k, every=20):
    ok = {}
    for key, v in rows:
        if key is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[key] = np.array(v, np.float32).astype(float)
    size = max({len(v) for v in ok.values()}, key=lambda n: sum(len(v) == n for v in ok.values()))
    ok = {k2: v for k2, v in ok.items() if len(v) == size}
    out = {}
    for q in ok:
        if q % every == 0:
            scored = sorted(((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_tables_are_searched_whole(stored):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]                  # ties: copies of one vector
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7),
             (480, [float("inf")] + [1.0] * 7), (500, [1.0, 2.0]), (520, []), (None, [1.0] * 8)]
    df = stored([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got, want = result(nearest(df, k=5)), brute(rows, 5)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_shards_and_blocks_agree(stored):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(250)]
    df = stored([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = result(nearest(df, k=4, every=5, shard_rows=40, query_rows=10))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {
        q: [i for i, _ in v] for q, v in brute(rows, 4, 5).items()}


def test_fewer_candidates_than_asked_and_empty(stored):
    df = stored([(0, [1.0, 2.0], 1, "", ""), (1, [2.0, 1.0], 1, "", "")], SCHEMA)
    assert result(nearest(df, k=20)) == {0: [(1, 4.0)]}
    assert nearest(df.limit(0)).collect() == []


def test_forest_takes_longest_prefixes_first():
    rng = np.random.default_rng(2)
    points = lifted(rng.normal(size=(3000, 16)), 10.0)
    codes = strings(points, rotations(17, 6))
    forest = Forest(codes)
    shared = np.zeros((len(points), 6), int)
    for depth in range(1, SYMBOLS + 1):
        cut = 15 * (SYMBOLS - depth)
        shared += (codes >> cut) == (codes[0] >> cut)
    for enough in (1, 20, 200):
        got = set(next(forest.candidates(codes[:1], enough)).tolist())
        depth = max(d for d in range(SYMBOLS + 1) if (shared.max(axis=1) >= d).sum() >= enough)
        assert got == set(np.flatnonzero(shared.max(axis=1) >= depth).tolist())


def test_recall_against_brute_force(spark):
    """Some ten thousand vectors without any clusters, the hardest case: production parameters."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(10_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, hits = result(nearest(df)), 0
    x = x.astype(float)
    for q in range(0, 10_000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {i for i, _ in got[q]})
    assert len(got) == 500 and hits / 2000 >= 0.9
