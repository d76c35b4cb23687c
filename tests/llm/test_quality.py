import random

import pytest
from pyspark.sql import functions as F

from queuelens.llm.quality import BINS, binned, classify, learn
from tests.llm.conftest import prose


def corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        site = f"h{i % 5}"
        bad = rng.random() < (0.9 if site == "h0" else 0.1)
        text = " ".join(w + "!!!" for w in prose(rng, "aa", 40).upper().split()) if bad else prose(rng, "aa", 40)
        rows.append((i, text, site, "p" if i % 2 else None))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


@pytest.fixture(scope="module")
def site(stored):
    rows, labels = corpus(random.Random(0))
    return (stored(rows, "doc_id long, text string, host string, path string"),
            stored(labels + [(None, 1), (7, None), (0, 0), (0, 0)], "doc_id long, quality int"), rows)


def test_separates_and_shrinks(site):
    docs, labels, rows = site
    got = {r.doc_id: r for r in classify(docs, labels, F.col("host"), F.col("path")).collect()}
    wrong = sum(got[i].kept == ("!!!" in t) for i, t, _, _ in rows)
    assert len(got) == len(rows) and wrong == 0
    assert got[0].host_rate < 0.4 < 0.7 < got[1].host_rate
    assert all(0 <= r.score <= 1 for r in got.values())


def test_sparse_sites_lean_on_the_global_rate(stored, site):
    docs, labels, _ = site
    lone = stored([(9999, "TOR!!! ING!!! THE!!! " * 15, "lonely", None)], "doc_id long, text string, host string, path string")
    got = classify(docs.unionByName(lone), labels, F.col("host"), F.col("path"))
    lonely = got.filter("doc_id = 9999").first()
    overall = got.agg(F.avg("host_rate")).first()[0]
    assert 0.4 * overall < lonely.host_rate < overall


def test_evidence_matches_counts(site):
    import math
    docs, labels, _ = site
    rows = binned(docs, "text", {"_key": F.col("doc_id")})
    ratio, prior = learn(rows, labels, "doc_id", "quality")
    table = {r["_key"]: r for r in rows.collect()}
    truth = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            truth[r.doc_id] = max(truth.get(r.doc_id, 0), r.quality)
    kinds = len(BINS["symbols"]) + 1
    for b in range(2 * kinds, 3 * kinds):          # all these texts are long
        n = [sum(table[k]["_b_symbols"] == b for k, y in truth.items() if y == z) for z in (0, 1)]
        t = [sum(y == z for y in truth.values()) for z in (0, 1)]
        want = math.log((n[1] + 0.5) / (t[1] + 0.5 * kinds)) - math.log((n[0] + 0.5) / (t[0] + 0.5 * kinds))
        assert ratio["symbols"][b] == pytest.approx(want)
    assert len(ratio["symbols"]) == 3 * kinds and ratio["symbols"][:2 * kinds] == [0.0] * (2 * kinds)
    assert prior == pytest.approx((t[1] + 1) / (sum(t) + 2))


def test_odd_rows(odd, none, stored):
    labels = stored([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    got = classify(odd, labels, F.col("source"), F.col("lang"))
    assert got.count() == odd.count()
    assert got.filter("score is null or kept is null or isnan(score)").count() == 0
    assert classify(none, labels, F.col("source"), F.col("lang")).collect() == []
    unlabelled = classify(odd, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {round(r.evidence, 9) for r in unlabelled} == {0.0}


def test_posteriors_match_plain_python(site):
    """Rates, strengths by moments and scores, computed anew from each document's evidence."""
    import math
    docs, labels, rows = site
    got = {r.doc_id: r for r in classify(docs, labels, F.col("host"), F.col("path")).collect()}
    taught = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and r.doc_id in got:
            taught[r.doc_id] = max(taught.get(r.doc_id, 0), r.quality)
    prior = (sum(taught.values()) + 1) / (len(taught) + 2)
    p = {i: 1 / (1 + math.exp(-(r.evidence + math.log(prior / (1 - prior))))) for i, r in got.items()}
    hosts, paths = {}, {}
    for i, _, h, s in rows:
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, s), []).append(p[i])

    def strength(groups, rate_of, rate):
        n = sum(map(len, groups.values()))
        over = sum(len(v) * (sum(v) / len(v) - rate_of(k)) ** 2 - rate_of(k) * (1 - rate_of(k)) for k, v in groups.items()) / n
        return min(max(rate * (1 - rate) / over - 1, 1.0), 1e4) if over > 0 else 1e4

    rate = sum(p.values()) / len(p)
    outer = strength(hosts, lambda _: rate, rate)
    host_rate = {h: (sum(v) + outer * rate) / (len(v) + outer) for h, v in hosts.items()}
    inner = strength(paths, lambda k: host_rate[k[0]], rate)
    for i, _, h, s in rows:
        v = paths[h, s]
        own = (sum(v) - p[i] + inner * host_rate[h]) / (len(v) - 1 + inner)
        score = 1 / (1 + math.exp(-(got[i].evidence + math.log(own / (1 - own)))))
        assert got[i].host_rate == pytest.approx(host_rate[h]) and got[i].path_rate == pytest.approx(own)
        assert got[i].score == pytest.approx(score) and got[i].kept == (got[i].score >= 0.5)


def test_held_out_labels(spark):
    """Learned from four fifths of the labels, judged on the other fifth."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = classify(docs, labels.filter(~out), F.col("source"), F.col("lang"))
    seen = labels.filter(out).select(F.col("doc_id").alias("_d"), F.col("quality").cast("int").alias("_y"))
    n = {(r["_y"], r["kept"]): r["count"] for r in got.join(seen, F.col("doc_id") == F.col("_d")).groupBy("_y", "kept").count().collect()}
    print("held out (good?, kept):", n)
    bad, good = n.get((0, True), 0) + n.get((0, False), 0), n.get((1, True), 0) + n.get((1, False), 0)
    assert bad > 50 and good > 300
    assert n.get((0, True), 0) <= 0.1 * bad and n.get((1, False), 0) <= 0.02 * good
