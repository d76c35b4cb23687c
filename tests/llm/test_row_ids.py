"""Rows keep their ids when a table's scan is split otherwise between two reads of it."""

import random

import pytest

from queuelens.llm.common import numbered
from queuelens.llm.exact_dedup import drop_exact_duplicates
from queuelens.llm.lm_scoring import score_documents
from queuelens.llm.mixing import mixed_order
from queuelens.llm.ngram_join import drop_near_duplicates
from queuelens.llm.warc import payload_digest, to_records
from tests.llm.conftest import prose

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Six files of unequal size; every third text stands twice."""
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("split") / "t.parquet")
    key = 0
    for f in range(6):
        rows = []
        for i in range((30, 5, 60, 15, 90, 40)[f]):
            text = prose(rng, "aa", 40)
            rows += [(key + j, text, f"s{i % 2}") for j in range(2 if i % 3 == 0 else 1)]
            key = rows[-1][0] + 1
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def split(spark):
    def into(n):
        spark.conf.set(SPLITS, str(n))
    yield into
    spark.conf.unset(SPLITS)


def test_ids_do_not_depend_on_splits(spark, table, split):
    found = []
    for n in (6, 1):
        split(n)
        docs, row = numbered(spark.read.parquet(table).filter("doc_id >= 0"))
        found.append({r.doc_id: r[row] for r in docs.collect()})
    assert found[0] == found[1] and len(set(found[0].values())) == len(found[0])


def test_other_frames_are_numbered_once(spark, table, split):
    docs = spark.read.parquet(table)
    twice = docs.unionByName(docs)
    got, row = numbered(twice)
    split(1)
    rows = got.collect()
    assert len({r[row] for r in rows}) == len(rows) == 2 * docs.count()


@pytest.mark.parametrize("drop", [drop_exact_duplicates, drop_near_duplicates])
def test_the_right_documents_are_dropped(spark, table, split, drop):
    docs = spark.read.parquet(table)
    split(6)
    left = drop(docs)
    split(1)
    texts = [r.text for r in left.collect()]
    assert sorted(texts) == sorted({r.text for r in docs.collect()})


def test_mixed_order_keeps_every_row(spark, table, split):
    docs = spark.read.parquet(table)
    split(6)
    got = mixed_order(docs, block=2)
    split(1)
    assert sorted(got.collect()) == sorted(docs.collect())


def test_records_have_their_own_digest(spark, table, split):
    pages = spark.read.parquet(table).selectExpr("doc_id AS page_id", "text AS html")
    split(6)
    records = to_records(pages)
    split(1)
    rows = records.withColumn("own", payload_digest("payload")).filter("record_type = 'response'").collect()
    assert rows and all(r.payload_digest == "sha1:" + r.own for r in rows)


def test_scores_belong_to_their_keys(spark, table, split):
    docs = spark.read.parquet(table)
    split(6)
    want = {r.doc_id: round(r.score, 6) for r in score_documents(docs).collect()}
    got = score_documents(docs)
    split(1)
    assert {r.doc_id: round(r.score, 6) for r in got.collect()} == want


def test_file_names_with_other_digits():
    from queuelens.llm.common import _by_number
    assert sorted(["a٣b", "a10b", "a2b", "ab"], key=_by_number) == ["a2b", "a10b", "ab", "a٣b"]
