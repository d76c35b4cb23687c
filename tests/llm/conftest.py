import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "_row string, shard string, _lang string, _text string, size string, node string")
SYLLABLES = {"aa": "tor ing the ed on er st ly".split(), "bb": "zü kö sch ung heit ver ge".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def odd_rows(n=60, seed=1):
    """Rows with nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        rows.append([i, prose(rng, lang, rng.randint(5, 60)), lang, f"s{i % 4}"])
    base = rows[1][1]
    rows += [[n, base, "aa", "s1"], [n + 1, base, "aa", None], [n + 1, base, "aa", None],      # ties, a repeated row
             [n + 2, None, None, None], [n + 3, None, "aa", "s0"], [n + 4, "", "bb", "s0"], [n + 5, " \t\n", None, "s2"],
             [None, prose(rng, "aa", 30), "aa", "s0"], [None, base, None, None],
             [n + 6, prose(rng, "bb", 20_000), "bb", "s1"], [n + 7, "12 34 !! 5", "aa", "s3"],
             [n + 8, base.upper(), "aa", "s1"], [n + 9, base + " end", "aa", "s1"], [n + 10, "one", "aa", "s1"],
             [n + 11, "naïve 日本語 😀 one", None, "s1"]]
    return [(*r, None if r[1] is None else len(r[1]), *["x"] * 6) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3, "n_chars").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes rows as Parquet and reads them again, as the operators read stored tables."""
    def write(rows, schema):
        path = str(tmp_path_factory.mktemp("t") / "t.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)
    return write
