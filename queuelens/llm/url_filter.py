"""URL rules by a cascade of Bloom filters.

Level 1 holds the listed keys; level 2 the keys of the corpus that level 1
takes for listed by mistake; level 3 the listed keys that level 2 takes for
mistakes, and so on until a level makes no mistake. For every key the cascade
was built over, the number of levels that accept it in a row says exactly
whether it is listed. The levels are bit strings inside the plan, so a table
is judged where it lies, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import settle

BUCKET_BITS = 32768                        # fixed value: bits of one bitmap of Spark's bitmap functions
PASS_BYTES = 1 << 23                       # levels that one pass over the rows may carry
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """A Bloom filter of ``size`` bits; ``probes`` of them stand for a key."""

    bits: bytes
    size: int
    probes: int
    seed: int

    @staticmethod
    def positions(key: Column, size: int, probes: int, seed: int) -> list[Column]:
        start, step = F.xxhash64(F.lit(2 * seed), key), F.xxhash64(F.lit(2 * seed + 1), key)
        odd = F.pmod(step, F.lit(size))
        return [F.pmod(F.pmod(start, F.lit(size)) + i * odd + i * (i + 1) // 2, F.lit(size)) for i in range(probes)]

    def accepts(self, key: Column) -> Column:
        """Whether all bits of ``key`` are set; the first that is not ends the test."""
        def is_set(at: Column) -> Column:
            byte = F.hex(F.substring(F.lit(bytearray(self.bits)), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)))
            return F.getbit(F.conv(byte, 16, 10).cast("long"), at.bitwiseAND(F.lit(7)).cast("int")) == 1

        return reduce(lambda a, b: a & b, map(is_set, self.positions(key, self.size, self.probes, self.seed)))

    @staticmethod
    def build(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
        """Filter of the one column of ``keys``; about ``rate`` of other keys are taken by mistake."""
        probes = max(1, round(-math.log2(rate)))
        size = 64 + math.ceil(count * -math.log2(rate) / math.log(2))
        key = F.col(keys.columns[0])
        at = keys.select(F.explode(F.array(*Level.positions(key, size, probes, seed))).alias("at"))
        bits = bytearray(-(-size // BUCKET_BITS) * BUCKET_BITS // 8)
        one = F.col("at") + 1
        for bucket in (at.groupBy(F.bitmap_bucket_number(one).alias("bucket"))
                       .agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bitmap")).collect()):
            begin = (bucket["bucket"] - 1) * BUCKET_BITS // 8
            bits[begin:begin + len(bucket["bitmap"])] = bucket["bitmap"]
        return Level(bytes(bits[:-(-size // 8)]), size, probes, seed)


@dataclass(frozen=True)
class Cascade:
    """Alternating levels; exact for every key of the universe it was built over."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Accepted by an odd number of levels before the first that refuses, or by all of an odd number."""
        listed = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            listed = F.when(self.levels[depth - 1].accepts(key), listed).otherwise(F.lit(depth % 2 == 0))
        return listed

    @property
    def size(self) -> int:
        return sum(len(level.bits) for level in self.levels)

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, rows: int, seed: int = 0) -> Cascade:
        """Cascade of the keys in ``listed`` over those in ``universe`` and ``listed``.

        Both have one column of strings without nulls and may repeat keys.
        ``rows`` is about the size of the universe and only sets the first
        level's rate. The universe is read once; of its keys only those that
        the first level accepts are kept, each once, summed up before they move.
        """
        listed = settle(listed.toDF("_key").distinct())
        count = listed.count()
        if not count:
            return Cascade(())
        rate = min(0.5, count / max(1, rows) * math.sqrt(0.5))
        first = Level.build(listed, count, rate, seed)
        accepted = universe.toDF("_key").filter(first.accepts(F.col("_key"))).select("_key", F.lit(False).alias("_listed"))
        wrong = settle(accepted.unionByName(listed.withColumn("_listed", F.lit(True)))
                       .groupBy("_key").agg(F.max("_listed").alias("_listed")).filter(~F.col("_listed")).select("_key"))
        levels, held, other = [first], listed, wrong
        while left := other.count():
            level = Level.build(other, left, 0.125, seed + len(levels))
            levels.append(level)
            held, other = other, settle(held.filter(level.accepts(F.col("_key"))))
        return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys that a rule of some (labels of the host, length of the path) would have to fit this address."""
    parts = F.split(host, r"\.", -1)
    return F.filter(F.array(*[
        F.when((host != "") & (F.size(parts) >= labels) & (F.length(path) >= length),
               F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))
        for labels, length in shapes]), lambda k: k.isNotNull())


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per page: ``key``, host, path, rule and verdict.

    ``rules`` has columns host, path ('' or starting with '/') and verdict
    (allow or block). A rule fits its host and all subdomains if the path
    starts with its path; the longest rule (host and path together, then the
    host alone) wins, and ``default`` is the verdict where none fits, as the
    cascade finds nothing listed there. A null url, or one without ``://``,
    has an empty host and path and no rule. Rules with an empty or null host
    are ignored; one given both verdicts blocks. Repeated rows are each
    judged, an empty table gives no rows, without rules every verdict is
    ``default``, urls may be of any length, and further columns are not read.

    One cascade says which of an address's possible keys is a rule, a second
    which rule blocks. What travels with the plan is their bits. If these
    exceed ``pass_bytes`` the rules are dealt to as many parts by hash, each
    with its own cascade and its own pass over the stored rows.
    """
    listed = settle(rules.filter(F.col("host") != "").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"),
        (F.col("verdict") == "block").alias("block"))
        .select(F.concat("host", "path").alias("rule"), "block",
                F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("length"))
        .groupBy("rule", "labels", "length").agg(F.max("block").alias("block")))
    shapes = sorted((r["labels"], r["length"]) for r in listed.select("labels", "length").distinct().collect())
    rows = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shapes:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = rule_keys(F.col("host"), F.col("path"), shapes)
    universe = rows.select(F.explode(keys).alias("_key"))
    total, size = listed.count(), pages.count()
    bits = total * 1.5 * max(2.0, math.log2(1 + size / total) + 4)
    parts = max(1, math.ceil(bits / 8 / pass_bytes))

    out = rows.withColumn("_best", F.lit(None).cast("struct<n:int,m:int,rule:string,block:boolean>"))
    for part in range(parts):
        def mine(k: Column, part: int = part) -> Column:
            return F.pmod(F.xxhash64(k), F.lit(parts)) == part

        own = listed.filter(mine(F.col("rule")))
        is_rule = Cascade.build(own.select("rule"), universe.filter(mine(F.col("_key"))), max(1, size // parts))
        blocks = Cascade.build(own.filter("block").select("rule"), own.select("rule"), total // parts, seed=1 << 16)
        hits = F.filter(rule_keys(F.col("host"), F.col("path"), shapes),
                        lambda k: (mine(k) if parts > 1 else F.lit(True)) & is_rule.contains(k))
        best = F.array_max(F.transform(hits, lambda k: F.struct(
            F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("m"), k.alias("rule"),
            blocks.contains(k).alias("block"))))
        out = out.withColumn("_best", F.greatest("_best", best))
        if part + 1 < parts:
            out = settle(out)
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best.block"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))
