import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from queuelens.llm.lm_scoring import LatticeModel, Pieces, load_pieces, score_documents, tokens


def segmentations(word, pieces):
    text = b" " + word
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = [text[a:b] for a, b in zip(at, at[1:])]
        if all(p in pieces for p in parts):
            yield parts


def toy():
    p = {b" ": 0.1, b"a": 0.2, b"b": 0.1, b" a": 0.15, b"ab": 0.2, b" ab": 0.05, b"bab": 0.1, b"c": 0.1}
    return Pieces(list(p), np.log(np.array(list(p.values())))), p


def test_forward_sums_all_segmentations():
    pieces, p = toy()
    words = [b"a", b"ab", b"abab", b"babab", b"cab", b"ccc"]
    got = pieces.likelihood(words)
    want = [math.log(sum(math.prod(p[x] for x in s) for s in segmentations(w, p))) for w in words]
    assert np.allclose(got, want)
    assert pieces.likelihood([b"abx"])[0] == -np.inf


def test_expected_counts():
    pieces, p = toy()
    got = np.zeros(len(p))
    pieces.likelihood([b"abab", b"ab"], got)
    want = Counter()
    for w in (b"abab", b"ab"):
        all_s = [(math.prod(p[x] for x in s), s) for s in segmentations(w, p)]
        total = sum(q for q, _ in all_s)
        for q, s in all_s:
            for x in s:
                want[x] += q / total
    assert np.allclose(got, [want[x] for x in p])


def test_vocabulary_covers_every_byte():
    pieces = load_pieces()
    assert all(bytes([b]) in set(pieces.strings) for b in range(256))
    assert np.isclose(np.exp(pieces.logp).sum(), 1.0)
    assert np.isfinite(pieces.likelihood(["日本😀".encode(), b"\xff\x00", b"the"])).all()


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def test_documents_against_sums_over_words(odd):
    rows = odd.collect()
    train = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    ends = sum(not held(r.doc_id) for r in rows)
    n, v = sum(train.values()) + ends, len(train) + 1

    def base(c):
        return math.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    got = score_documents(odd, head=10)          # most words take the joined way
    want = Counter()
    for r in rows:
        words = tokens(r.text)
        want[(r.doc_id, held(r.doc_id), len(words) + 1, sum(w in train for w in words) + 1, n,
              round(sum(base(train[w]) for w in words) + base(ends), 6))] += 1
    found = got.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_score_against_the_model_fitted_in_one_place(odd):
    rows = odd.collect()
    train = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    ends = sum(not held(r.doc_id) for r in rows)
    pieces = load_pieces()
    for _ in range(4):
        expected = np.zeros(len(pieces.strings))
        for w in sorted(train):                                      # one word at a time
            pieces.likelihood([w], expected)
        pieces = pieces.weighted(expected)
    n, v = sum(train.values()) + ends, len(train) + 1
    one, two = (sum(c == k for c in train.values()) for k in (1, 2))
    d = min(max(one / (one + 2 * two) if one and two else 0.5, 0.05), 0.95)

    def log10_of(c, base):
        return math.log10(max(c - d, 0) / n + d * v / n * base)

    own = {w: log10_of(train[w], math.exp(pieces.likelihood([w])[0]) * v / (v + 1))
           for w in {t for r in rows for t in tokens(r.text)}}
    end = log10_of(ends, 1 / (v + 1))
    want = Counter((r.doc_id, round(sum(own[w] for w in tokens(r.text)) + end, 3)) for r in rows)
    for head in (10, 1 << 16):
        assert Counter((r.doc_id, round(r.score, 3)) for r in score_documents(odd, head=head).collect()) == want


def test_scores_do_not_depend_on_the_table_of_frequent_words(odd):
    few, many = ({(r.doc_id, r.n_tokens, round(r.score, 6)) for r in score_documents(odd, head=head).collect()}
                 for head in (10, 1 << 16))
    assert few == many


def test_word_probabilities_do_not_exceed_one():
    pieces, p = toy()
    model = LatticeModel(pieces, tokens=50, kinds=4, ends=5, discount=0.5)
    seen = {b"ab": 30, b"a": 10, b"cab": 5}
    alphabet = [bytes(w) for n in range(1, 6) for w in itertools.product(b"abc", repeat=n)]
    total = 10 ** model.end() + (10 ** model.words(alphabet, np.array([seen.get(w, 0) for w in alphabet]))).sum()
    assert total <= 1 + 1e-9


def test_empty_and_no_training(none, stored):
    assert score_documents(none).collect() == []
    only = next(i for i in range(100) if held(i))
    row = score_documents(stored([(only, "a b")], "doc_id long, text string")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0.0) and math.isfinite(row.score)
