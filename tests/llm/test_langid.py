import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from queuelens.llm.langid import identify, fit, keep_known_languages, predict_languages, predictor, train
from tests.llm.conftest import prose


def kneser_ney(counts, order, word):
    """Probability of a word by the textbook recursion over strings."""
    def grams(n):
        raw, types = Counter(), set()
        for w, c in counts.items():
            s = "^" + w + "$"
            for i in range(1, len(s)):
                if i - n + 1 >= 0:
                    raw[s[i - n + 1:i + 1]] += c
                if i - n >= 0:
                    types.add(s[i - n:i + 1])
        if n == order:
            return raw
        left = Counter(t[1:] for t in types)
        return Counter({g: raw[g] if g[0] == "^" and n > 1 else left[g] for g in raw})

    tables = {n: grams(n) for n in range(1, order + 1)}
    letters = len(set("".join(counts))) + 2

    def p(n, gram):
        if n == 0:
            return 1 / letters
        table = tables[n]
        ones = sum(v == 1 for v in table.values())
        twos = sum(v == 2 for v in table.values())
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        ctx = [v for g, v in table.items() if g[:-1] == gram[:-1]]
        if not ctx:
            return p(n - 1, gram[1:])
        return max(table[gram] - d, 0) / sum(ctx) + d * len(ctx) / sum(ctx) * p(n - 1, gram[1:])

    s, out = "^" + word + "$", 0.0
    for i in range(1, len(s)):
        n = min(order, i + 1)
        out += np.log2(p(n, s[i - n + 1:i + 1]))
    return out


def test_scores_follow_the_recursion():
    counts = Counter({"the": 5, "then": 2, "hen": 1, "ten": 3, "eth": 1, "net": 1})
    model = train({"x": counts}, order=3)
    words = ["the", "then", "hat", "q", "nnn", "tent"]
    got, sizes = model.word_scores(words)
    assert np.allclose(got[:, 0], [kneser_ney(counts, 3, w) for w in words])
    assert sizes.tolist() == [len(w) + 1 for w in words]


def test_words_share_a_probability_of_one():
    model = train({"x": Counter({"ab": 4, "ba": 1, "aab": 2, "b": 3})}, order=3)
    words = ["".join(w) for n in range(1, 13) for w in itertools.product("ab", repeat=n)]
    total = np.exp2(model.word_scores(words)[0]).sum()
    assert 0.5 < total <= 1 + 1e-9


def test_languages_and_rejection(odd, none):
    rows = {r.doc_id: r for r in predict_languages(odd).collect() if r.doc_id is not None}
    truth = {r.doc_id: r for r in odd.collect()}
    for i in range(60):
        assert rows[i].lang_pred == truth[i].lang and 0 <= rows[i].score <= 1
    for i in (62, 63, 64, 65):
        assert rows[i].lang_pred == "und" and rows[i].rejected and rows[i].score == 0
    assert predict_languages(odd).count() == odd.count()
    assert predict_languages(none).collect() == []
    kept = keep_known_languages(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(60)) <= ids and not ids & {62, 63, 64, 65}
    assert keep_known_languages(none).collect() == []


def test_gibberish_is_rejected(stored):
    rng = random.Random(3)
    rows = [(i, prose(rng, "aa", 50), "aa") for i in range(60)]
    noise = "".join(rng.choice("qxjwvkzpfbmcyu") + (" " if rng.random() < 0.2 else "") for _ in range(3000))
    docs = stored([*rows, (99, noise, None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r["_lang"].rejected for r in identify(docs, fit(docs)).collect()}
    assert found.pop(99) and not any(found.values())


def test_a_stray_label_does_not_end_rejection(stored):
    """A language that one document taught has no calibration document and predicts any text evenly."""
    rng = random.Random(3)
    rows = [(i, prose(rng, "aa", 50), "aa") for i in range(60)] + [(70, "zwölf boxkämpfer jagen viktor quer", "xx")]
    noise = ["".join(rng.choice("qxjwvkzpfbmcyu") + (" " if rng.random() < 0.2 else "") for _ in range(3000)),
             " ".join(f"{rng.getrandbits(64):016x}" for _ in range(200)),
             "мой дядя самых честных правил когда не в шутку занемог " * 5]
    docs = stored(rows + [(100 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in keep_known_languages(docs).collect()}
    assert kept == {i for i, *_ in rows}


def test_no_labels(stored):
    docs = stored([(1, "some words", None), (2, "", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in predict_languages(docs).collect()} == {
        1: ("und", False), 2: ("und", True)}


def test_a_task_holds_few_texts_and_words_at_a_time(spark):
    """Texts of a batch of Arrow are read and their words scored a few at a time, whatever the batch holds."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(500)) for _ in range(400)]
    texts[7], texts[300] = None, "12 34"
    predict = predictor(train({"x": Counter({"abba": 4, "cab": 1}), "y": Counter({"jig": 2})})).func
    assert len(list(predict(iter([pa.array(texts[:2])])))) == 1          # compiled and imported
    batch = pa.array(texts)
    tracemalloc.start()
    found = [r for b in predict(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, r in enumerate(found) if r["lang_pred"] == "und"] == [7, 300] and len(found) == 400
    assert peak < 90e6                               # 200,000 words and their scores; all scored at once took 209 MB
    some = [r for b in predict(iter([batch.slice(0, 9), batch.slice(9, 291), batch.slice(300)])) for r in b.to_pylist()]
    assert some == found
