"""Distinct counts from merged bitmaps against sets in plain Python."""

import random
from itertools import product

from queuelens.operators import distincts as D

SETS = [["k", "y"], ["k"], ["y"], []]


def counts(rows):
    out = {}
    for k, y, v in rows:
        for gk, gy in product((0, 1), repeat=2):
            if v is not None:
                out.setdefault((None if gk else k, None if gy else y, 2 * gk + gy), set()).add(v)
    return {key: len(s) for key, s in out.items()}


def test_every_grain_equal_to_sets(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randint(1, 3), rng.choice([None, "", "x", f"n{rng.randint(0, 300)}"]))
            for _ in range(2000)]
    maps = D.bitmaps(spark.createDataFrame(rows, "k string, y int, v string"), ["k", "y"], "v", ranges=5)
    got = {(r["k"], r["y"], r["grain"]): r["names"] for r in D.rolled_up(maps, SETS, "names").collect()}
    assert got == counts(rows)


def test_more_values_than_a_bitmap_holds(spark):
    df = spark.range(100_000).selectExpr("CAST(id % 2 AS STRING) AS k", "CAST(id % 3 AS INT) AS y", "id DIV 2 AS v")
    got = {(r["k"], r["y"]): r["names"] for r in D.rolled_up(D.bitmaps(df, ["k", "y"], "v"), SETS, "names").collect()}
    assert got[(None, None)] == 50_000 and got[("0", None)] == got[("1", None)] == 50_000
    assert got[(None, 0)] == len({i // 2 for i in range(0, 100_000, 3)})


def test_parts_merge_without_the_values(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in [(1, "p"), (1, "q"), (2, "q"), (2, "r"), (3, "p")]], "k string, y int, v string")
    maps = D.bitmaps(df, ["k", "y"], "v")
    early, late = maps.filter("y = 1"), maps.filter("y > 1")
    whole = D.rolled_up(D.merged(early, late, keys=["k"]), [["k"]], "names").collect()
    assert [(r["k"], r["names"]) for r in whole] == [("a", 3)]


def test_empty_and_nulls_only(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, y int, v string")
    assert D.rolled_up(D.bitmaps(df, ["k", "y"], "v"), SETS, "names").collect() == []
    assert D.rolled_up(D.bitmaps(df.limit(0), ["k", "y"], "v"), SETS, "names").collect() == []
