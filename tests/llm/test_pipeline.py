"""The stages against plain Python on the same rows, and the registered queries' shapes."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

from queuelens.llm.queries import QUERIES, SQL
from tests.llm.conftest import prose
from tests.llm.test_ngram_join import edited, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, lang, rng.randint(30, 90)) for lang in ("aa", "bb") for _ in range(60)]
    texts += [texts[3]] * 5 + [edited(rng, texts[7], 1) for _ in range(5)] + ["", None, "1 2 3", "... --- ..."]
    rows = [(i, t, "aa" if i < 60 else "bb", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("pipe")
    (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
     .repartition(2).write.parquet(str(path / "documents.parquet")))
    return str(path), rows


def expected(rows):
    """Keys that stay: a letter, the largest of equal texts, the smallest of each near-duplicate group."""
    left = {k: t for k, t, *_ in rows if t and any(map(str.isalpha, t))}
    last = {}
    for k in sorted(left):
        last[left[k]] = k
    left = {k: t for t, k in last.items()}
    sets, keys = {k: shingles(t, 5) for k, t in left.items()}, sorted(left)
    group = {k: k for k in keys}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in keys if find(k) == k}


def test_run_against_plain_python(spark, folder):
    path, rows = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == expected(rows) and len(got) == len(expected(rows))
    words = {k: len((t or "").split()) for k, t, *_ in rows}
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == words[r.doc_id] <= r.bucket_len
        batches[(r.bucket, r.batch)].append(r)
    assert all(len(b) == 1 or len(b) * b[0].bucket_len <= 16384 for b in batches.values())


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "ngram_jaccard_join", "pfair_mix", "length_buckets"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder[0]).columns == docs.columns
    assert corpus_pipeline.length_buckets(spark, docs.limit(0), folder[0]).collect() == []


def test_registered_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = duck.execute(SQL[name])
    columns = [d[0] for d in rows.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, rows.fetchall()))


@pytest.mark.parametrize("name", ["op1_jump_shards", "op2_pfair_mix", "op4_kneser_ney_langid", "op5_ngram_join",
                                  "op7_lattice_likelihood", "op8_site_quality", "op9_length_buckets"])
def test_queries_return_every_document(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select("doc_id").collect()
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_kneser_ney_langid"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    told = [r.lang_pred == r.lang for r in rows.collect() if r.lang is not None]
    assert len(told) > 100 and sum(told) / len(told) >= 0.98
