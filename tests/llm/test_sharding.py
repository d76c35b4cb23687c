import zlib
from collections import Counter

import numpy as np

from queuelens.llm.sharding import assign_shards, jump


def reference_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_follows_the_published_recurrence():
    rng = np.random.default_rng(0)
    keys = np.concatenate([np.array([0, 1, -1, 2**63 - 1, -2**63]), rng.integers(-2**63, 2**63 - 1, 300)])
    for n in (1, 2, 3, 16, 17, 1000):
        assert jump(keys, n).tolist() == [reference_jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20_000) * 2654435761
    a, b = jump(keys, 16), jump(keys, 17)
    assert set(b[a != b]) == {16}
    assert abs((a != b).mean() - 1 / 17) < 0.01


def test_assign_shards(odd):
    rows = assign_shards(odd, 4).collect()
    given = odd.select("doc_id", "text").collect()
    assert len(rows) == len(given)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    where = {}
    for r in rows:
        assert where.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.law == "key" and r.grown_shard in (r.shard, 4)


def test_empty(none):
    assert assign_shards(none).collect() == []


def test_most_frequent_is_bounded(spark):
    from queuelens.llm.common import most_frequent
    counts = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(5000, 0)], "k long, c long")
    for bound in (0, 1, 10, 500, 2000):
        got = sorted(r.c for r in most_frequent(counts, "c", bound).collect())
        assert len(got) <= bound and got == list(range(1001 - len(got), 1001))
    assert len(most_frequent(counts, "c", 500).collect()) > 400
