import random
from collections import Counter

from pyspark.sql import functions as F

from queuelens.llm.url_filter import Cascade, judge_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.net", "", "allow"), ("net", "/long/path", "block"),
         ("both.org", "/", "allow"), ("both.org", "/", "block"), ("UPPER.org", "/", "block"), ("", "/", "block"), (None, "/x", "block")]
TYPES = "host string, path string, verdict string"
URLS = [None, "", "no scheme", "example.com/en/", "http://", "https://example.com", "https://example.com/en/", "HTTP://WWW.Example.COM/en/a?b#c",
        "http://sub.www.example.com/en/x", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://a.net", "http://b.a.net?q",
        "http://a.net/long/path/es/", "http://n.net/long/path", "http://user@example.com:80/en/", "http://example.com./en/", "http://..com/", "http://com/",
        "a?b#c://x.com/y", "http://both.org/z", "http://upper.org/", "http://ÄÖ.com/ü/日本", "http://x.com/" + "p/" * 30_000, "http://" + "a." * 5_000 + "net/fr/",
        "http://a.com/\n?x", "http://x.com\n/y"]
LETTERS = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def first(text, stops):
    return min([text.find(s) for s in stops if s in text], default=len(text))


def brute(url, rules=RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        tail = url[url.index("://") + 3:]
        cut = first(tail, "/?#")
        host, rest = tail[:cut].translate(LETTERS), tail[cut:]
        path = rest[:first(rest, "?#")]
    fits = []
    for h, p, verdict in rules:
        h = (h or "").translate(LETTERS)
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, verdict == "block"))
    if not fits:
        return host, path, None, default
    return host, path, max(fits)[2], "block" if max(fits)[3] else "allow"


def pages(stored):
    rng = random.Random(3)
    some = [f"http://{rng.choice('abcd')}.{rng.choice(['x', 'example'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{i}"
            for i in range(300)]
    rows = [(i if i != 5 else None, u, "x", "x", "x") for i, u in enumerate(URLS + some + URLS[:9])]
    return stored(rows, "page_id long, url string, host string, rule string, _key string")


def test_against_brute_force(spark, stored):
    table = pages(stored)
    want = Counter((r.page_id, *brute(r.url)) for r in table.collect())
    rules = spark.createDataFrame(RULES, TYPES)
    for pass_bytes in (1 << 23, 12):                        # one part, several parts
        got = judge_urls(table, rules, pass_bytes=pass_bytes)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert Counter(map(tuple, got.collect())) == want


def test_empty(spark, stored):
    table, rules = pages(stored), spark.createDataFrame(RULES, TYPES)
    assert judge_urls(table.limit(0), rules).collect() == []
    got = judge_urls(table, rules.limit(0), default="block").collect()
    assert len(got) == table.count() and {(r.rule, r.verdict) for r in got} == {(None, "block")}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    listed = keys.filter("id % 37 = 0").select("k")
    for rows in (30_000, 50):                               # a good and a bad first level
        cascade = Cascade.build(listed, keys.select("k").union(keys.select("k")), rows)
        assert len(cascade.levels) > 1
        got = keys.select(cascade.contains(F.col("k")).alias("c"), (F.col("id") % 37 == 0).alias("t")).groupBy("c", "t").count().collect()
        assert {tuple(r) for r in got} == {(True, True, 811), (False, False, 29_189)}
        assert rows == 50 or cascade.size < 811 * 2


def test_main_path_has_no_python_and_no_join(spark, stored):
    plan = judge_urls(pages(stored), spark.createDataFrame(RULES, TYPES))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Join", "Exchange"))
