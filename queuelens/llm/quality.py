"""Document quality with host and path posteriors by empirical Bayes.

A document's evidence is a sum of log likelihood ratios of binned text
measures, learned from labelled rows. The classifier's soft verdicts are
summed per host and per path; a host's rate is shrunk toward the global rate
and a path's toward its host's, each by a prior whose strength is estimated
from how much sites differ beyond chance. A document is judged by its own
evidence against its path's rate without itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import settle

# Upper ends of each measure's bins; a last bin is open.
BINS = {
    "words": (0, 5, 20, 50, 150, 500, 2000, 10000),
    "word_length": (3.0, 4.0, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0),
    "symbols": (0.005, 0.02, 0.03, 0.04, 0.06, 0.1, 0.15, 0.25),
    "capitals": (0.005, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.0, 0.01, 0.03, 0.1, 0.3),
    "distinct_words": (0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "distinct_lines": (0.2, 0.5, 0.7, 0.9, 0.99),
}
# Shares of a few words scatter more than those of many, so the other measures are judged within these word counts.
LENGTHS = (8, 30)
SMOOTH = 0.5


def measures(text: str) -> dict[str, Column]:
    """Shape of a text by built-in functions; a null text counts as empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(body, "\n")
    n = F.greatest(F.size(words), F.lit(1))
    chars = F.greatest(F.char_length(body), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern)) / chars

    return {
        "words": F.size(words), "word_length": F.char_length(body) / n,
        "symbols": share(r"[^\p{L}\p{N}\s]"), "capitals": share(r"\p{Lu}"), "digits": share(r"\p{Nd}"),
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def binned(docs: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    def bin_of(name: str, value: Column) -> Column:
        out = F.lit(len(BINS[name]))
        for i, top in reversed(list(enumerate(BINS[name]))):
            out = F.when(F.col(f"_m_{name}") <= top, F.lit(i)).otherwise(out)
        if name == "words":
            return out
        length = F.lit(len(LENGTHS))
        for i, top in reversed(list(enumerate(LENGTHS))):
            length = F.when(F.col("_m_words") <= top, F.lit(i)).otherwise(length)
        return out + length * (len(BINS[name]) + 1)

    found = measures(text)
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), *(c.alias(f"_m_{k}") for k, c in found.items()))
    return rows.select(*keep, *(bin_of(k, c).alias(f"_b_{k}") for k, c in found.items()))


def learn(rows: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[dict[str, list[float]], float]:
    """Log likelihood ratio of each bin (within its length), and the labelled share of good documents.

    A key labelled both ways counts for its larger label.
    """
    taught = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
              .groupBy(F.col(key).alias("_lk")).agg(F.max(F.col(label).cast("int")).alias("_y")))
    both = rows.join(taught, F.col("_key") == F.col("_lk"))
    long = both.select("_y", F.explode(F.map_from_arrays(
        F.array(*(F.lit(k) for k in BINS)), F.array(*(F.col(f"_b_{k}") for k in BINS)))).alias("_f", "_bin"))
    counts = {(r["_f"], r["_bin"], r["_y"]): r["n"]
              for r in long.groupBy("_f", "_bin", "_y").agg(F.count("*").alias("n")).collect()}    # bounded by BINS
    out: dict[str, list[float]] = {}
    for f, tops in BINS.items():
        kinds, out[f] = len(tops) + 1, []
        for first in range(0, kinds * (1 if f == "words" else len(LENGTHS) + 1), kinds):
            n = [[counts.get((f, b, y), 0) + SMOOTH for b in range(first, first + kinds)] for y in (0, 1)]
            out[f] += [math.log(good / sum(n[1])) - math.log(bad / sum(n[0])) for bad, good in zip(*n)]
    total = {y: sum(n for (f, _, z), n in counts.items() if f == "words" and z == y) for y in (0, 1)}
    return out, (total[1] + 1) / (total[0] + total[1] + 2)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(rate: float, between: float) -> float:
    """Pseudo-documents of a Beta prior with this mean whose sites differ with variance ``between``."""
    full = rate * (1 - rate)
    return min(max(full / between - 1, 1.0), 1e4) if between > 0 and full > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5,
             key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Every row with its evidence, host and path rates, score (0 to 1) and whether it is kept.

    Null hosts form a host of their own, and so null paths within a host.
    Rows that repeat a key are judged one by one and share its label. With no
    labels all evidence is 0. An empty table gives no rows.
    """
    rows = settle(binned(docs, text, {"_key": F.col(key), "_host": host.cast("string"), "_path": path.cast("string")}))
    ratio, prior = learn(rows, labels, key, label)
    evidence = F.lit(0.0)
    for f, values in ratio.items():
        evidence += F.element_at(F.array(*(F.lit(v) for v in values)), F.col(f"_b_{f}") + 1)
    base = math.log(prior / (1 - prior))
    rows = (rows.select("_key", F.struct(F.col("_host")).alias("_h"), F.struct("_host", "_path").alias("_s"),
                        evidence.alias("evidence"))
            .withColumn("_p", _sigmoid(F.col("evidence") + base)))
    paths = (rows.groupBy("_h", "_s").agg(F.sum("_p").alias("_good"), F.count("*").alias("_n")))
    paths = settle(paths)
    hosts = settle(paths.groupBy("_h").agg(F.sum("_good").alias("_host_good"), F.sum("_n").alias("_host_n")))
    g = hosts.agg(F.sum("_host_good").alias("good"), F.sum("_host_n").alias("n")).first()
    rate = min(max((g["good"] or 0.0) / g["n"], 1e-6), 1 - 1e-6) if g["n"] else prior
    # variance of site rates over documents, less what chance gives sites of this size
    m = F.col("_host_good") / F.col("_host_n")
    over = hosts.agg((F.sum(F.col("_host_n") * (m - rate) ** 2 - rate * (1 - rate)) / F.sum("_host_n")).alias("v")).first()["v"]
    strength = _strength(rate, over or 0.0)
    hosts = hosts.withColumn("host_rate", (F.col("_host_good") + strength * rate) / (F.col("_host_n") + strength))
    both = settle(paths.join(hosts.select(F.col("_h").alias("_hh"), "host_rate"), F.col("_h") == F.col("_hh")).drop("_hh"))
    m, r = F.col("_good") / F.col("_n"), F.col("host_rate")
    over = both.agg((F.sum(F.col("_n") * (m - r) ** 2 - r * (1 - r)) / F.sum("_n")).alias("v")).first()["v"]
    inner = _strength(rate, over or 0.0)
    own = (F.col("_good") - F.col("_p") + inner * F.col("host_rate")) / (F.col("_n") - 1 + inner)
    return (rows.drop("_h").join(both.select(F.col("_s").alias("_ss"), "_good", "_n", "host_rate"),
                                 F.col("_s") == F.col("_ss"))
            .withColumn("path_rate", own)
            .withColumn("score", _sigmoid(F.col("evidence") + _logit(F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6)))))
            .select(F.col("_key").alias(key), "evidence", "host_rate", "path_rate", "score",
                    (F.col("score") >= threshold).alias("kept")))
