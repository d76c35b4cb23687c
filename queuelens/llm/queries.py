"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.ann import nearest
from queuelens.llm.common import read_table
from queuelens.llm.exact_dedup import exact_duplicates
from queuelens.llm.hard_negatives import hard_negatives
from queuelens.llm.langid import predict_languages
from queuelens.llm.lm_scoring import score_documents
from queuelens.llm.mixing import mix
from queuelens.llm.ngram_join import near_duplicates
from queuelens.llm.packing import pack
from queuelens.llm.quality import classify
from queuelens.llm.sharding import assign_shards
from queuelens.llm.url_filter import judge_urls
from queuelens.llm.vector_codes import compress
from queuelens.llm.warc import archive_round_trip


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), 16)


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), keep=("doc_id",))


def op3_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op4_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no address: their source stands for the host, source and language for the path."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                    host=F.col("source"), path=F.col("lang"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_jump_shards, op2_pfair_mix, op3_hash_forest, op4_kneser_ney_langid, op5_ngram_join, op6_exact_dedup, op7_lattice_likelihood,
    op8_site_quality, op9_length_buckets, op10_warc_round_trip, op11_bloom_cascade, op12_hard_negatives, op13_pivot_codes)}

WHOLE_VECTOR = """embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""


def codes_sql(rounds: int = 6) -> str:
    """Lloyd rounds written out one after the other, over the 64 components of every vector."""
    def nearest(book: str) -> str:
        # distance and index in one number, so that the smallest is the nearest entry with the lowest index
        return f"""SELECT vec_id, p, min(gap * 16 + e) AS best FROM (
            SELECT v.vec_id, v.p, c.e, sum((v.x - c.x) * (v.x - c.x)) AS gap
            FROM parts v JOIN {book} c ON c.p = v.p AND c.i = v.i GROUP BY v.vec_id, v.p, c.e) GROUP BY vec_id, p"""

    steps = []
    for r in range(rounds):
        steps.append(f"""near{r} AS MATERIALIZED ({nearest(f"book{r}")}),
        mean{r} AS MATERIALIZED (
            SELECT v.p, n.best % 16 AS e, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n
            FROM parts v JOIN near{r} n ON n.vec_id = v.vec_id AND n.p = v.p GROUP BY v.p, n.best % 16, v.i),
        book{r + 1} AS MATERIALIZED (
            SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
            FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e AND m.i = b.i)""")
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE {WHOLE_VECTOR}),
        parts AS MATERIALIZED (
            SELECT vec_id, j // 8 AS p, j % 8 AS i, CAST(floor(4096 * CAST(embedding[j + 1] AS DOUBLE)) AS BIGINT) AS x
            FROM kept, range(64) t(j)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
        book0 AS MATERIALIZED (SELECT p, e, i, x FROM parts JOIN first USING (vec_id)),
        {", ".join(steps)},
        near AS MATERIALIZED ({nearest(f"book{rounds}")}),
        coded AS (
            SELECT vec_id, string_agg('0' || substr('0123456789abcdef', CAST(best % 16 AS INTEGER) + 1, 1), '' ORDER BY p) AS code,
                   CAST(sum(best // 16) AS BIGINT) AS error
            FROM near GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


def buckets_sql(buckets: int = 16, budget: int = 16384) -> str:
    """The recurrence over all cuts, a step per bucket; the test tables are stored in the order of doc_id."""
    steps = []
    for k in range(1, buckets):
        steps.append(f"""try{k} AS MATERIALIZED (
            SELECT a.j, min((b.best + a.e * (a.upto - b.upto)) * 16777216 + b.j) AS found
            FROM step{k - 1} a JOIN step{k - 1} b ON b.j < a.j GROUP BY a.j),
        step{k} AS MATERIALIZED (
            SELECT s.j, s.e, s.upto, least(s.best, found // 16777216) AS best,
                   CASE WHEN found // 16777216 < s.best THEN {k} ELSE s.k END AS k,
                   CASE WHEN found // 16777216 < s.best THEN found % 16777216 ELSE s.i END AS i
            FROM step{k - 1} s LEFT JOIN try{k} USING (j))""")
    path = " UNION ALL ".join(f"SELECT {k} AS upto_k, j, k, i FROM step{k}" for k in range(buckets))
    return f"""
        WITH RECURSIVE rows AS MATERIALIZED (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
        seen AS (SELECT greatest(n_tokens, 1) AS e, count(*) AS n FROM rows GROUP BY 1),
        step0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY e) AS HUGEINT) AS j, CAST(e AS HUGEINT) AS e, sum(n) OVER (ORDER BY e) AS upto,
                   e * sum(n) OVER (ORDER BY e) AS best, 0 AS k, CAST(0 AS HUGEINT) AS i
            FROM seen UNION ALL SELECT 0, 0, 0, 0, 0, 0),
        {", ".join(steps)},
        path AS MATERIALIZED ({path}),
        back AS (
            SELECT max(j) AS j, {buckets - 1} AS k FROM step0
            UNION ALL SELECT p.i, greatest(p.k - 1, 0) FROM back b JOIN path p ON p.j = b.j AND p.upto_k = b.k WHERE b.j > 0),
        bounds AS (
            SELECT CAST(e AS BIGINT) AS bucket_len, CAST(row_number() OVER (ORDER BY e) - 1 AS INTEGER) AS bucket,
                   lag(e, 1, 0) OVER (ORDER BY e) AS above FROM back JOIN step0 USING (j) WHERE j > 0),
        placed AS (
            SELECT doc_id, n_tokens, bucket, bucket_len, greatest(1, {budget} // bucket_len) AS fit,
                   row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS slot
            FROM rows JOIN bounds ON greatest(n_tokens, 1) > above AND greatest(n_tokens, 1) <= bucket_len)
        SELECT doc_id, n_tokens, bucket, bucket_len, CAST(slot // fit AS BIGINT) AS batch,
               CAST(slot % fit AS INTEGER) AS batch_row, bucket_len - n_tokens AS padding
        FROM placed"""


SQL = {
    "op9_length_buckets": buckets_sql(),
    "op11_bloom_cascade": """
        WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
        a AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
        SELECT page_id, host, path,
               CASE WHEN starts_with(path, '/en/') AND (host = 'www.example.com' OR ends_with(host, '.www.example.com')) THEN 'www.example.com/en/'
                    WHEN starts_with(path, '/en/') AND (host = 'example.com' OR ends_with(host, '.example.com')) THEN 'example.com/en/'
                    WHEN starts_with(path, '/') AND (host = 'com' OR ends_with(host, '.com')) THEN 'com/'
                    WHEN starts_with(path, '/es/') AND (host = 'net' OR ends_with(host, '.net')) THEN 'net/es/'
                    WHEN starts_with(path, '/fr/') AND (host = 'net' OR ends_with(host, '.net')) THEN 'net/fr/' END AS rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM a""",
    "op12_hard_negatives": f"""
        WITH r AS MATERIALIZED (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND {WHOLE_VECTOR}),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
                   AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_pivot_codes": codes_sql(),
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM d WINDOW same AS (PARTITION BY text_sha256)""",
    "op10_warc_round_trip": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id,
                     list_transform(range(8), lambda g: ('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT) AS v FROM p)
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((v[1 + i // 4] >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url AS target_uri
        FROM q""",
}
