"""Document likelihood under a subword lattice.

The pieces and first scores come from an existing vocabulary file; nothing is
trained on pieces' shapes. A word's probability sums all of its segmentations
by a forward recursion in log space. The pieces' probabilities are refitted
to the corpus by expected counts over all distinct training words, and words
seen in training are arcs of the lattice, too, with their absolutely
discounted frequency; the discounted mass is what the pieces share:

    P(w) = max(c - d, 0) / N + d * V / N * (V / (V + 1)) * sum over segmentations

The end of a text is a token with base probability 1 / (V + 1).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import most_frequent, numbered, settle, utf8
from queuelens.llm.langid import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
STEP = np.uint64(0x9E3779B97F4A7C15)
WORDS = 100_000                           # put through the lattice together
FLOOR = 1e-9                              # probability that refitting leaves any piece


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space of a text in UTF-8, with A-Z lower-cased."""
    return text.lower().split()


def tokens(text: str | None) -> list[bytes]:
    return [] if text is None else words_of(text.encode("utf-8", "surrogatepass"))


def _slot(h: np.ndarray, mask: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * STEP >> np.uint64(40)).astype(np.int64) & mask


@dataclass
class Pieces:
    """Piece strings (word start as one blank) found by hash, with natural-log probabilities.

    The hash table also has the pieces' prefixes, so that a search stops
    where no piece can follow.
    """

    strings: list[bytes]
    logp: np.ndarray
    _key: np.ndarray = field(default=None, repr=False)
    _entry: np.ndarray = field(default=None, repr=False)
    _piece: np.ndarray = field(default=None, repr=False)
    _longer: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self._key is not None:
            return
        entries: dict[bytes, int] = {}
        piece, longer = [], []
        for i, s in enumerate(self.strings):
            for n in range(1, len(s) + 1):
                e = entries.setdefault(s[:n], len(entries))
                if e == len(piece):
                    piece.append(-1)
                    longer.append(False)
                if n == len(s):
                    piece[e] = i
                else:
                    longer[e] = True
        self._piece, self._longer = np.array(piece, np.int32), np.array(longer)
        keys = np.zeros(len(entries), np.uint64)
        with np.errstate(over="ignore"):
            for s, e in entries.items():
                h = keys[entries[s[:-1]]] if len(s) > 1 else np.uint64(0)
                keys[e] = h * STEP + np.uint64(s[-1] + 1)
        size = 1 << max(10, (8 * len(entries)).bit_length())
        self._key, self._entry = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for e, at in enumerate(_slot(keys, size - 1).tolist()):
            while self._entry[at] >= 0:
                at = (at + 1) & (size - 1)
            self._key[at], self._entry[at] = keys[e], e

    def weighted(self, weight: np.ndarray) -> Pieces:
        p = weight / weight.sum() + FLOOR
        return replace(self, logp=np.log(p / p.sum()))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Table entry of each hash, -1 where there is none."""
        at = _slot(h, len(self._key) - 1)
        out = self._entry[at]
        rest = np.flatnonzero((out >= 0) & (self._key[at] != h))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self._key) - 1)
            out[rest] = self._entry[at[rest]]
            rest = rest[(out[rest] >= 0) & (self._key[at[rest]] != h[rest])]
        return out

    def arcs(self, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) over words of one length, given as rows of bytes, by start."""
        n, size = letters.shape
        columns = np.ascontiguousarray(letters.T).astype(np.uint64) + np.uint64(1)
        for i in range(size):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i, size):
                h = h * STEP + columns[j][rows]
                e = self._find(h)
                there = e >= 0
                rows, h, e = rows[there], h[there], e[there]
                piece = self._piece[e]
                own = piece >= 0
                if own.any():
                    yield i, j + 1, rows[own], piece[own]
                more = self._longer[e]
                rows, h = rows[more], h[more]
                if not len(rows):
                    break

    def likelihood(self, words: list[bytes], expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's probability over all segmentations.

        ``expected`` gets the pieces' expected counts added, if given.
        """
        out = np.zeros(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            step = max(1, 2_000_000 // (int(size) + 1))
            for lo in range(0, len(own), step):
                part = own[lo:lo + step]
                raw = b"".join(b" " + words[i] for i in part)
                letters = np.frombuffer(raw, np.uint8).reshape(len(part), int(size) + 1)
                ahead = np.full((len(part), int(size) + 2), -np.inf)
                ahead[:, 0] = 0.0
                kept, used, shares = [], [], []
                for i, j, rows, piece in self.arcs(letters):
                    ahead[rows, j] = np.logaddexp(ahead[rows, j], ahead[rows, i] + self.logp[piece])
                    if expected is not None:
                        kept.append((i, j, rows, piece))
                out[part] = ahead[:, -1]
                if expected is None:
                    continue
                behind = np.full_like(ahead, -np.inf)
                behind[:, -1] = 0.0
                for i, j, rows, piece in reversed(kept):
                    through = self.logp[piece] + behind[rows, j]
                    behind[rows, i] = np.logaddexp(behind[rows, i], through)
                    used.append(piece)
                    shares.append(np.exp(ahead[rows, i] + through - ahead[rows, -1]))
                if used:                  # once per part: the counts are as long as the vocabulary
                    expected += np.bincount(np.concatenate(used), weights=np.concatenate(shares), minlength=len(expected))
        return out


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces of a vocabulary file that lower-cased text can show, and all single bytes.

    A score s of this kind of file is minus a rank; its first probability is
    taken in proportion to 1 / (1 - s).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): FLOOR for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode("utf-8")
        if piece == piece.lower() and b" " not in piece[1:]:
            weight[piece] = weight.get(piece, 0.0) + 1.0 / (1.0 - min(model.get_score(i), 0.0))
    names = sorted(weight)
    p = np.array([weight[s] for s in names])
    return Pieces(names, np.log(p / p.sum()))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, as the lattice's arrays pay off on many words at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def word_counts(docs: DataFrame, text: str, training: str, distinct: int = 500_000) -> DataFrame:
    """word, c: every distinct word of the table with its count in training rows."""

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary(), size=len(seen)),
                                           pa.array(seen.values(), pa.int64(), size=len(seen))], ["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for body, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if learn:
                    seen.update(words_of(body))
                else:
                    for w in set(words_of(body)):
                        seen[w] += 0
                if len(seen) >= distinct:
                    yield counted(seen)
                    seen.clear()
        yield counted(seen)

    return (docs.select(utf8(text).alias("_text"), F.col(training).alias("_train"))
            .mapInArrow(count, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


@dataclass
class LatticeModel:
    pieces: Pieces
    tokens: int                           # N, ends included
    kinds: int                            # V, with the end
    ends: int                             # documents
    discount: float

    def _log10(self, c: np.ndarray, base: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.log10(np.maximum(base, 1e-300))
        n = float(self.tokens)
        return np.log10(np.maximum(c - self.discount, 0) / n + self.discount * self.kinds / n * base)

    def words(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        """log10 probability of each word with training count ``c``."""
        lattice = self.pieces.likelihood(words)
        seen = self._log10(c.astype(float), np.exp(lattice) * self.kinds / (self.kinds + 1))
        rare = ~(seen > -300)             # below what a double holds: stay in log space
        seen[rare] = (lattice[rare] + np.log(self.kinds / (self.kinds + 1) * (
            self.discount * self.kinds / self.tokens if self.tokens else 1.0) or 1e-300)) / np.log(10)
        return seen

    def end(self) -> float:
        return float(self._log10(np.array([float(self.ends)]), np.array([1 / (self.kinds + 1)]))[0])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))


def fit(counts: DataFrame, documents: int, pieces: Pieces, rounds: int = 1) -> LatticeModel:
    """Model of settled ``word_counts`` and the number of training documents."""
    seen = counts.filter("c > 0")
    s = seen.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                 F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    for _ in range(rounds):
        own = pieces

        def expect(batches: Iterator[pa.RecordBatch], own: Pieces = own) -> Iterator[pa.RecordBatch]:
            got = np.zeros(len(own.strings))
            for batch in gathered(batches):
                own.likelihood(batch.column(0).to_pylist(), got)
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got[at])], ["piece", "e"])

        found = (seen.select("word").mapInArrow(expect, "piece int, e double")
                 .groupBy("piece").agg(F.sum("e").alias("e")).collect())      # bounded by the vocabulary
        weight = np.zeros(len(pieces.strings))
        for r in found:
            weight[r["piece"]] = r["e"]
        if weight.sum() > 0:
            pieces = pieces.weighted(weight)
    d = s["one"] / (s["one"] + 2 * s["two"]) if s["one"] and s["two"] else 0.5
    return LatticeModel(pieces, s["n"] + documents, s["v"] + (documents > 0), documents, min(max(d, 0.05), 0.95))


ROW = "_row long, word binary, m long, base double, lm double, known long"


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = 1 << 16, warm: int = 3,
                    rounds: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its log10 probability; rows with crc32(key) mod 10 = 0 are not learned from.

    The pieces' probabilities take ``warm`` and then ``rounds`` steps, each
    over all distinct training words. The ``head`` most frequent words go to
    the tasks as a table of that fixed size and are summed in place; a
    document's other words meet the distributed word table in a join and come
    back as sums per row. So ``head`` changes where work is done and no score. A null or
    empty text is the end token alone; repeated rows are scored each; further
    columns are not read; an empty table gives no rows.
    """
    docs, row = numbered(docs)
    rows = docs.select(F.col(row).alias("_row"), F.col(key).alias("_key"),
                       held_out(key, 10, 0).alias("held_out"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("_train", ~F.col("held_out"))
    counts = settle(word_counts(rows, "_text", "_train"))
    documents = rows.filter("_train").count()
    top = most_frequent(counts, "c", head).collect()                          # bounded by `head`
    words, c = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], float)
    model = fit(counts, documents, load_pieces(vocabulary), warm + rounds)
    frequent = dict(zip(words, zip(model.words(words, c).tolist(), model.base(c).tolist(), (c > 0).tolist())))
    end_lm, end_base, end_known = model.end(), float(model.base(np.array([float(documents)]))[0]), int(documents > 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None, None, None)
        for batch in batches:
            rest: list[bytes] = []                # words not in the table, document after document
            times: list[int] = []
            sizes, sums = [], []
            ids = batch.column(0).to_pylist()
            for at, body in enumerate(batch.column(1).to_pylist()):
                lm, base, known, n, first = end_lm, end_base, end_known, 1, len(rest)
                for w, m in Counter(words_of(body)).items():
                    n += m
                    hit_lm, hit_base, hit_known = frequent.get(w, nothing)
                    if hit_lm is None:
                        rest.append(w)
                        times.append(m)
                    else:
                        lm += m * hit_lm
                        base += m * hit_base
                        known += m * hit_known
                sizes.append(len(rest) - first)
                sums.append((n, base, lm, known))
                if len(rest) >= 200_000 or at + 1 == len(ids):
                    own = np.array(ids[at + 1 - len(sizes):at + 1], np.int64)
                    n_, base_, lm_, known_ = (np.array(c) for c in zip(*sums))
                    none = np.zeros(len(rest))
                    # no word has a blank, so a document's own row meets none and rows spread
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.repeat(own, sizes), own])),
                         pa.array(rest + [b" %d" % row for row in own.tolist()], pa.binary()),
                         pa.array(np.concatenate([np.array(times, np.int64), n_.astype(np.int64)])),
                         pa.array(np.concatenate([none, base_.astype(float)])),
                         pa.array(np.concatenate([none, lm_.astype(float)])),
                         pa.array(np.concatenate([none.astype(np.int64), known_.astype(np.int64)]))],
                        ["_row", "word", "m", "base", "lm", "known"])
                    rest, times, sizes, sums = [], [], [], []

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            lm = model.words(batch.column(0).to_pylist(), c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lm), pa.array(model.base(c))],
                                             ["word", "c", "w_lm", "w_base"])

    priced = (counts.mapInArrow(price, "word binary, c long, w_lm double, w_base double")
              .select(F.col("word").alias("_w"), "w_lm", "w_base", (F.col("c") > 0).cast("int").alias("w_known")))
    own = F.col("_w").isNull()
    sums = (rows.select("_row", utf8("_text").alias("_text")).mapInArrow(split, ROW)
            .join(priced, F.col("word") == F.col("_w"), "left")
            .groupBy("_row").agg(
                F.sum(F.when(own, F.col("m"))).alias("n_tokens"),
                F.sum(F.when(own, F.col("known")).otherwise(F.col("m") * F.col("w_known"))).alias("n_known"),
                F.sum(F.when(own, F.col("base")).otherwise(F.col("m") * F.col("w_base"))).alias("base_score"),
                F.sum(F.when(own, F.col("lm")).otherwise(F.col("m") * F.col("w_lm"))).alias("score")))
    return (rows.select("_row", "_key", "held_out").join(sums, "_row")
            .select(F.col("_key").alias(key), "held_out", "n_tokens", "n_known",
                    F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
