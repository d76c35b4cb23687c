import hashlib
from collections import Counter, defaultdict

from queuelens.llm.exact_dedup import digests, drop_exact_duplicates, exact_duplicates, heavy_winners


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(key)
    out = Counter()
    for digest, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        kept = False
        for k in keys:
            mine = k == best and not kept
            kept |= mine
            out[(k, best, len(keys), mine, digest)] += 1
    return out


def test_against_brute_force(odd):
    for heavy in (1, 4, 512):
        got = exact_duplicates(odd, heavy=heavy)
        assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_hot_text_is_split_off(stored):
    docs = stored([(i, "same" if i % 3 == 0 else f"text {i % 50}") for i in range(900)], "doc_id long, text string")
    hot = heavy_winners(digests(docs), 8).collect()
    assert [r["_n"] for r in hot] == [300]
    assert Counter(map(tuple, exact_duplicates(docs, heavy=8).collect())) == brute(
        [(r.doc_id, r.text) for r in docs.collect()])


def test_drop(odd, none):
    left = drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == odd.selectExpr("coalesce(text, '') t").distinct().count()
    assert exact_duplicates(none).collect() == [] and drop_exact_duplicates(none).collect() == []


def test_main_path_has_no_python(odd):
    plan = exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
