"""Language identification with interpolated Kneser-Ney character models.

Every language has a character n-gram model over words (with their ends). The
models share one sorted array of n-gram hashes per order; a row of it holds
the interpolated probability under each language. A document goes to the
language with the lowest cross-entropy per character, and is rejected where
that entropy is higher than calibration documents of the language ever show.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from queuelens.llm.common import fresh

WORDS = re.compile(r"[^\W\d_]+")
FIRST, LAST = 2, 3                      # codes of a word's ends, below any letter's
UNDETERMINED = "und"
STEP = 0x9E3779B97F4A7C15               # odd multiplier of the rolling hash
MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their ends, place of each code in its word, index of its word."""
    text = "".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    codes = np.empty(int(sizes.sum()) + 2 * len(words), np.uint32)
    inner = np.ones(len(codes), bool)
    inner[starts] = inner[starts + sizes + 1] = False
    codes[inner] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + 8
    codes[starts], codes[starts + sizes + 1] = FIRST, LAST
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    return codes, np.arange(len(codes)) - starts[owner], owner


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n codes that end at each place."""
    one = _mix(codes.astype(np.uint64) * np.uint64(STEP) + np.uint64(1))
    out, factor = [one], 1
    for n in range(1, order):
        factor = factor * STEP & MASK
        longer = out[-1].copy()
        longer[n:] += one[:-n] * np.uint64(factor)
        out.append(longer)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in the sorted array (0 where missing) and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


@dataclass
class Model:
    languages: list[str]
    order: int
    floor: float                        # probability of a code never seen
    grams: list[np.ndarray]             # per order the sorted hashes
    probs: list[np.ndarray]             # per order (hash, language): interpolated probability
    contexts: list[np.ndarray]          # per order the sorted context hashes
    backoff: list[np.ndarray]           # per order (context, language): weight of the shorter order
    usual: np.ndarray                   # per language: mean surprisal of a character
    spread: np.ndarray                  # and its standard deviation
    slack: np.ndarray                   # and how far calibration documents lie above
    z: float = 6.0                      # deviations allowed besides, fewer characters more
    judged: np.ndarray | None = None    # per language: has calibration documents of its own

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, language) log2 probability, and the codes predicted per word."""
        codes, place, owner = encode(words)
        ends = hashes(codes, self.order)
        logs = np.zeros((len(codes), len(self.languages)), np.float64)
        todo = np.flatnonzero(place > 0)
        weight = np.ones((len(codes), len(self.languages)))
        for n in range(self.order, 0, -1):
            own = place[todo] >= n - 1
            at = todo[own]
            i, there = _find(self.grams[n - 1], ends[n - 1][at])
            hit = at[there]
            logs[hit] = np.log2(self.probs[n - 1][i[there]] * weight[hit])
            miss = at[~there]
            before = ends[n - 2][miss - 1] if n > 1 else np.zeros(len(miss), np.uint64)
            i, known = _find(self.contexts[n - 1], before)
            weight[miss[known]] *= self.backoff[n - 1][i[known]]
            todo = np.concatenate([todo[~own], miss])
        logs[todo] = np.log2(self.floor * weight[todo])
        out = np.zeros((len(words), len(self.languages)))
        first = np.flatnonzero(place == 0)
        if len(first):
            out = np.add.reduceat(logs, first, axis=0)
        return out, np.bincount(owner, minlength=len(words)) - 1


def _language_counts(words: list[str], weights: np.ndarray, order: int):
    """Per order: (gram, suffix, context, count); shorter orders count left neighbours (Kneser-Ney)."""
    codes, place, owner = encode(words)
    ends = hashes(codes, order)
    raw = weights[owner].astype(np.float64)
    per_order, longer = [None] * order, None
    for n in range(order, 0, -1):
        own = np.flatnonzero((place >= n - 1) & (place > 0)) if n == order else \
            np.flatnonzero((place == n - 1) & (place > 0))
        at, count = own, raw[own]
        if longer is not None:                       # one for each distinct left neighbour
            at, count = np.concatenate([at, longer]), np.concatenate([count, np.ones(len(longer))])
        keys, first, inverse = np.unique(ends[n - 1][at], return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(keys))
        at = at[first]
        suffix = ends[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
        context = ends[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        per_order[n - 1] = (keys, suffix, context, total)
        longer = at[place[at] >= n - 1]
    return per_order


def train(counts: dict[str, Counter], order: int = 5) -> Model:
    """Kneser-Ney models of the languages' word counts, interpolated down to uniform."""
    languages = sorted(counts)
    nothing = np.zeros(len(languages))
    if not languages:
        return Model([], order, 1.0, [], [], [], [], nothing, nothing, nothing)
    stats = {lang: _language_counts(list(counts[lang]), np.array(list(counts[lang].values())), order)
             for lang in languages}
    letters = len(set("".join(w for c in counts.values() for w in c))) + 2
    floor = 1.0 / letters
    grams, probs, contexts, backoff = [], [], [], []
    for n in range(1, order + 1):
        parts = [stats[lang][n - 1] for lang in languages]
        keys, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        suffix = np.concatenate([p[1] for p in parts])[first]
        context = np.concatenate([p[2] for p in parts])[first]
        ctx = np.unique(np.concatenate([p[2] for p in parts]))
        alpha, gamma = np.zeros((len(keys), len(languages))), np.ones((len(ctx), len(languages)))
        for j, (k, _, c, count) in enumerate(parts):
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            at = np.searchsorted(ctx, c)
            total = np.bincount(at, weights=count, minlength=len(ctx))
            kinds = np.bincount(at, minlength=len(ctx))
            alpha[np.searchsorted(keys, k), j] = np.maximum(count - discount, 0) / total[at]
            seen = total > 0
            gamma[seen, j] = discount * kinds[seen] / total[seen]
        if n == 1:
            lower = np.full((len(keys), len(languages)), floor)
        else:
            i, there = _find(grams[-1], suffix)
            lower = np.where(there[:, None], probs[-1][i], floor)
        grams.append(keys)
        contexts.append(ctx)
        probs.append(alpha + gamma[np.searchsorted(ctx, context)] * lower)
        backoff.append(gamma)
    return Model(languages, order, floor, grams, probs, contexts, backoff, nothing, nothing, nothing)


def calibrate(model: Model, docs: dict[str, list[Counter]], z: float, margin: float) -> Model:
    """Learn what cross-entropy documents of each language show, ``z`` deviations aside.

    A language without such documents takes what those of all others show, with
    no margin, and what it rejects goes to the best of the others if that takes it.
    Only where no language has any is there nothing to judge by, and none rejects.
    """
    size = len(model.languages)
    usual, spread, slack = np.zeros(size), np.ones(size), np.full(size, np.inf)
    found: dict[int, list] = {}
    for j, lang in enumerate(model.languages):
        for words in docs.get(lang, []):
            if words:
                logs, n = model.word_scores(list(words))
                found.setdefault(j, []).append((-logs[:, j], n, np.array(list(words.values()))))

    def about(texts: list) -> tuple[float, float]:
        total = sum((n * c).sum() for _, n, c in texts)
        mean = sum((b * c).sum() for b, _, c in texts) / total
        return mean, np.sqrt(sum((c * (b - n * mean) ** 2).sum() for b, n, c in texts) / total)

    def above(texts: list, mean: float, deviation: float) -> float:
        over = [(b * c).sum() / (n * c).sum() - mean - z * deviation / np.sqrt((n * c).sum()) for b, n, c in texts]
        return max(0.0, *over) + margin

    for j, own in found.items():
        usual[j], spread[j] = about(own)
        slack[j] = above(own, usual[j], spread[j])
    rest = [j for j in range(size) if j not in found]
    if found and rest:                               # no document of its own to judge by: as the others together
        pool = [t for own in found.values() for t in own]
        mean, deviation = about(pool)
        # so thin a model spreads its mass over all text, which would pass with the margin of a well taught one
        usual[rest], spread[rest], slack[rest] = mean, deviation, above(pool, mean, deviation) - margin
    model.usual, model.spread, model.slack, model.z = usual, spread, slack, z
    model.judged = np.array([j in found for j in range(size)], bool)
    return model


def _some(texts: pa.Array, rows: int = 256, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in their order, a few at a time: at most ``rows``, and ``size`` bytes unless a single text has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, past = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, past + size, "right"))))
        yield texts.slice(lo, hi - lo).to_pylist()
        lo, past = hi, int(ends[hi - 1])


def held_out(key: str, modulus: int, rest: int) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus == rest


def fit(docs: DataFrame, sample: int = 400, order: int = 5, z: float = 6.0, margin: float = 2.5,
        key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model from a bounded sample: ``sample`` whole labelled documents per language.

    The sample has the smallest hashes of the key, a quarter of it only for
    calibration. Rows without a language or text are not sampled.
    """
    rank = Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), F.xxhash64("_text"))
    rows = (docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"),
                        F.col(lang).cast("string").alias("_lang"))
            .filter("_lang is not null and _text is not null"))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    # some eight times the sample by hash, then exactly the sample; counts have a row per language, as the model has
    draw = F.pmod(F.xxhash64("_text", "_key"), F.lit(1 << 30)) * F.col("_n") < F.lit(8.0 * sample * (1 << 30))
    rows = (rows.join(F.broadcast(counts.select(F.col("_lang").alias("_l"), "_n")), F.col("_lang") == F.col("_l"))
            .filter(draw).drop("_l", "_n")
            .withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for some in _some(batch["_text"]) for t in some)
            for lang, text, r in zip(batch["_lang"].to_pylist(), texts, batch["_r"].to_pylist()):
                found = Counter(WORDS.findall(text.lower()))
                own = r if r % 4 == 0 else 0         # the training part needs no documents
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array([own] * len(found), pa.int32()),
                         pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                        ["_lang", "_r", "word", "n"])

    table = (rows.select("_lang", "_text", "_r").mapInArrow(count, "_lang string, _r int, word string, n long")
             .groupBy("_lang", "_r", "word").agg(F.sum("n").alias("n")).collect())    # bounded by the sample
    training: dict[str, Counter] = {}
    trial: dict[str, dict[int, Counter]] = {}
    for r in table:
        if r["_r"]:
            trial.setdefault(r["_lang"], {}).setdefault(r["_r"], Counter())[r["word"]] += r["n"]
        else:
            training.setdefault(r["_lang"], Counter())[r["word"]] += r["n"]
    for name in set(trial) - set(training):          # a single document teaches, too
        training[name] = sum(trial[name].values(), Counter())
    model = train(training, order)
    return calibrate(model, {k: list(v.values()) for k, v in trial.items()}, z, margin)


PREDICTION = "lang_pred string, score double, cross_entropy double, rejected boolean"
KINDS = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]


def predictor(model: Model, cached: int = 400_000):
    """Arrow UDF text -> prediction; words seen before in the task are not scored again.

    Besides the batch as it comes, a task holds the scores of these words, the
    texts of one ``_some`` and what scoring 4096 words takes.
    """
    names = [*model.languages]
    own = model.judged if model.judged is not None else np.ones(len(names), bool)

    def words_of(text: str | None) -> list[str]:
        if text is None or not any(map(str.isalpha, text)):
            return []
        return WORDS.findall(text.lower())

    @arrow_udf(PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        logs, sizes = np.empty((4096, len(names))), np.empty(4096, np.int64)
        for batch in batches:
            out = []
            for texts in _some(batch):
                docs = [words_of(t) for t in texts]
                if len(known) > cached:
                    known.clear()
                new = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in known]
                if new and names:
                    had, need = len(known), len(known) + len(new)
                    if need > len(logs):             # twice the room, of which only what is filled takes memory
                        for_logs, for_sizes = np.empty((2 * need, len(names))), np.empty(2 * need, np.int64)
                        for_logs[:had], for_sizes[:had] = logs[:had], sizes[:had]
                        logs, sizes = for_logs, for_sizes
                    for lo in range(0, len(new), 4096):
                        some = new[lo:lo + 4096]
                        at = slice(had + lo, had + lo + len(some))
                        logs[at], sizes[at] = model.word_scores(some)
                    known.update(zip(new, range(had, need)))
                for words in docs:
                    if not words or not names:
                        out.append((UNDETERMINED, 0.0, None, not words))
                        continue
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    n = sizes[at].sum()
                    entropy = -logs[at].sum(axis=0) / n
                    j = int(np.argmin(entropy))
                    limit = model.usual + model.slack + model.z * model.spread / np.sqrt(n)
                    if entropy[j] > limit[j] and not own[j] and own.any():     # as if that language were not there
                        k = int(np.argmin(np.where(own, entropy, np.inf)))
                        j = k if entropy[k] <= limit[k] else j
                    share = 1.0 / np.exp2((entropy[j] - entropy) * min(n, 40)).sum()
                    out.append((names[j], float(share), float(entropy[j]), bool(entropy[j] > limit[j])))
            yield pa.StructArray.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*out) if out else [()] * 4, KINDS)],
                ["lang_pred", "score", "cross_entropy", "rejected"])
            del batch                                # before the next one comes

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "_lang") -> DataFrame:
    """``docs`` plus a struct column: lang_pred, score 0 to 1, cross_entropy, rejected.

    A null text and one without a letter are ``und`` with score 0 and
    rejected. Equal texts get equal results, of equally near languages the
    first by name; a language of three documents or fewer passes on what it
    rejects; only the text is read. A model that learned no language
    calls everything ``und`` and rejects only texts without a letter.
    """
    return docs.withColumn(into, predictor(model)(F.col(text).cast("string")))


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on rows that are not held out (crc32 of the key mod 4 is not 2) and predict every row.

    A null key is not held out; an empty table gives no rows; further
    columns are not read.
    """
    out = held_out(key, 4, 2)
    model = fit(docs.filter(~out), key=key, text=text, lang=lang)
    rows = docs.select(F.col(key).alias(key), out.alias("held_out"), F.col(text).alias("_text"))
    return (identify(rows, model, "_text")
            .select(key, "held_out", "_lang.lang_pred", "_lang.score", "_lang.cross_entropy", "_lang.rejected"))


def keep_known_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    into = fresh(docs, "_found")
    model = fit(docs, key=key, text=text, lang=lang)
    return identify(docs, model, text, into).filter(~F.col(f"{into}.rejected")).select(*docs.columns)
