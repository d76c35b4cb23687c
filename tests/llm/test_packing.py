import itertools
import random

import numpy as np
import pytest

from queuelens.llm.packing import best_bounds, pack


def padding(edges, counts, bounds):
    return sum(c * min(b for b in bounds if b >= e) for e, c in zip(edges, counts))


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    edges = sorted(rng.sample(range(1, 100), rng.randint(1, 9)))
    counts = [rng.randint(1, 50) for _ in edges]
    for k in (1, 2, 3, 20):
        got = best_bounds(np.array(edges), np.array(counts), k)
        assert got[-1] == edges[-1] and len(got) <= k
        best = min(padding(edges, counts, (*c, edges[-1]))
                   for n in range(min(k, len(edges))) for c in itertools.combinations(edges[:-1], n))
        assert padding(edges, counts, got) == best


def plain_bounds(edges, counts, buckets):
    """The same recurrence over all cuts, with the same choice among equals."""
    rows = [0, *itertools.accumulate(counts)]
    best, cuts = [0] + [e * r for e, r in zip(edges, rows[1:])], [[0] * (len(edges) + 1)]
    for _ in range(1, min(buckets, len(edges))):
        now, cut = best.copy(), [-1] * (len(edges) + 1)
        for j, e in enumerate(edges, 1):
            cost, i = min((best[i] + e * (rows[j] - rows[i]), i) for i in range(j))
            if cost < now[j]:
                now[j], cut[j] = cost, i
        best = now
        cuts.append(cut)
    bounds, j, k = [], len(edges), len(cuts) - 1
    while j > 0:
        k = max(x for x in range(k + 1) if cuts[x][j] >= 0)
        bounds.append(edges[j - 1])
        j, k = cuts[k][j], max(k - 1, 0)
    return bounds[::-1]


@pytest.mark.parametrize("seed", range(20))
def test_many_lengths_and_ties(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 40, 150])
    edges = sorted(rng.sample(range(1, 2 * n + 2), n)) if seed % 2 else [e * 10**6 for e in range(1, n + 1)]
    counts = [rng.choice([1, 1, 2, 3, 10**12 if seed % 5 == 0 else 7]) for _ in edges]
    for k in (1, 2, 7, 16, 200):
        assert best_bounds(np.array(edges), np.array(counts), k) == plain_bounds(edges, counts, k)


def test_two_hundred_thousand_lengths():
    got = best_bounds(np.arange(1, 200_001), np.ones(200_000, np.int64), 4)
    assert got == [50_000, 100_000, 150_000, 200_000]


def test_pack(odd, none):
    rows = pack(odd, buckets=3, budget=200).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in odd.collect() if r.doc_id is not None}
    assert len(rows) == odd.count()
    batches = {}
    for r in rows:
        if r.doc_id is not None:
            assert r.n_tokens == words[r.doc_id]
        assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (_, _), members in batches.items():
        assert sorted(m.batch_row for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_len <= 200
    assert len({r.bucket_len for r in rows}) <= 3
    assert pack(none).collect() == []


def test_a_bucket_is_as_long_as_its_longest_row(stored):
    lengths = [1001, 1001, 1003, 5003, 5011, 70_001]
    docs = stored([(i, "x " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = pack(docs, buckets=3, budget=10_030).collect()
    assert {r.doc_id: r.bucket_len for r in rows} == dict(enumerate([1003, 1003, 1003, 5011, 5011, 70_001]))
    assert max(r.batch_row for r in rows) == 2


def test_batches_follow_the_stored_mixture(spark, tmp_path):
    """Several files of unequal size, which a scan takes by falling size and not in order."""
    from queuelens.llm.mixing import mix, mixed_order
    rng = random.Random(6)
    rows = [(i, f"s{i % 3}", " ".join("x" * rng.randint(1, 3 + i % 3 * 40) for _ in range(rng.randint(1, 60))))
            for i in range(3000)]
    docs, path = str(tmp_path / "docs"), str(tmp_path / "mixed")
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(docs)
    docs = spark.read.parquet(docs)
    place = {r.doc_id: r.mix_position for r in mix(docs, {"s0": 8.0, "s1": 4.0, "s2": 1.0}, block=4, keep=("doc_id",)).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed_order(docs, {"s0": 8.0, "s1": 4.0, "s2": 1.0}, block=4).write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {f.stat().st_size for f in (tmp_path / "mixed").glob("part-*")}
    assert len(files) > 2
    got = {}
    for r in pack(spark.read.parquet(path), buckets=3, budget=400).collect():
        got.setdefault(r.bucket, []).append((r.batch, r.batch_row, place[r.doc_id]))
    for members in got.values():
        order = [p for _, _, p in sorted(members)]
        assert order == sorted(order)
