import math
import random

import pytest

from queuelens.llm.mixing import edf, mix, mixed_order, windows


@pytest.mark.parametrize("seed", range(8))
def test_deviation_stays_below_one_block(seed):
    """Against the fluid schedule in which sources that have run out give their share to the others."""
    rng = random.Random(seed)
    m = rng.randint(1, 9)
    blocks = [rng.randint(1, 60) for _ in range(m)]
    weights = [rng.uniform(0.05, 3) for _ in range(m)]
    total = sum(weights)
    weights = [w / total for w in weights]
    order = list(edf(blocks, weights))
    assert sorted(order) == [(s, k) for s in range(m) for k in range(1, blocks[s] + 1)]
    window = windows(blocks, weights)
    got, fluid = [0] * m, [0.0] * m
    for slot, (s, k) in enumerate(order):
        release, due = window(s, k)
        assert release <= slot < due
        assert k == got[s] + 1
        got[s] += 1
        left = 1.0
        while left > 1e-12:
            live = [i for i in range(m) if fluid[i] < blocks[i] - 1e-9]
            if not live:
                break
            w = sum(weights[i] for i in live)
            step = min([left, *((blocks[i] - fluid[i]) * w / weights[i] for i in live)])
            for i in live:
                fluid[i] += step * weights[i] / w
            left -= step
        assert all(abs(got[i] - fluid[i]) < 1 + 1e-6 for i in range(m))


def test_mix_places_every_row_once(odd):
    rows = mix(odd, {"s0": 0.5, "s1": 0.25, "s2": 0.25}, block=2, keep=("doc_id", "_row")).collect()
    assert sorted(r.mix_position for r in rows) == list(range(odd.count()))
    assert {r.mix_source for r in rows} == {"s0", "s1", "s2", "s3", None}
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.mix_slot, set()).add((r.mix_source, r.mix_block))
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    assert len([r for r in rows if r.mix_source == "s0"]) == odd.filter("source = 's0'").count()


def test_weights_hold_at_the_start(stored):
    docs = stored([(i, "a" if i % 10 else "b") for i in range(2000)], "doc_id long, source string")
    rows = sorted(mix(docs, {"a": 0.5, "b": 0.5}, block=5, keep=("doc_id",)).collect(), key=lambda r: r.mix_position)
    first = [r.mix_source for r in rows[:400]]
    assert abs(first.count("b") - 200) <= 5


def test_bad_weights(odd):
    with pytest.raises(ValueError):
        mix(odd, {"s0": 0.0})
    with pytest.raises(ValueError):
        mix(odd, {"s0": math.inf})


def test_mixed_order_keeps_rows_and_columns(odd, none):
    got = mixed_order(odd, block=2)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert mix(none, keep=("doc_id",)).collect() == [] and mixed_order(none).collect() == []
