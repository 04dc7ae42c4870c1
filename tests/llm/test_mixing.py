"""The mixing weights learn bit by bit, from the first byte of a text on, and start as training texts taught."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from liengrid.llm import mixing_model, texts


def plain_cost(tables, text, start):
    """Bits one after another: look up, mix, code, step."""
    data, offsets = mixing_model._sequence(*texts.text_bytes(pa.array([text])))
    contexts = mixing_model._contexts(data, offsets)
    weights = {(i, bit): start[i, bit] for i in range(len(tables)) for bit in range(8)}
    cost = 0.0
    for at, byte in enumerate(data.tolist()):
        for bit in range(8):
            node, sign = 1 << bit | byte >> (8 - bit), 2 * (byte >> (7 - bit) & 1) - 1
            inputs = [sign * float(t[c[at] + node]) for t, c in zip(tables, contexts)]
            odds = sum(weights[i, bit] * x for i, x in enumerate(inputs))
            odds = max(-mixing_model.MOST_ODDS, min(mixing_model.MOST_ODDS, odds))
            cost += math.log1p(math.exp(-odds))
            for i, x in enumerate(inputs):
                weights[i, bit] += mixing_model.RATE * x / (1 + math.exp(odds))
    return cost


def test_costs_are_those_of_bits_one_after_another():
    rng = np.random.default_rng(3)
    slots = np.unique(rng.integers(0, mixing_model._STARTS[-1], 400_000))
    tables = mixing_model._build_tables(slots, rng.integers(1, 50, len(slots)))
    samples = ["the thing that was " * 30, "", "Z", "a b " * 400, "été\n" * 9]
    for start in (np.full((3, 8), mixing_model.START_WEIGHT), rng.random((3, 8))):
        given = mixing_model._sequence(*texts.text_bytes(pa.array(samples)))
        got = mixing_model.text_costs(tables, *given, start)
        assert np.allclose(got, [plain_cost(tables, s, start) for s in samples], rtol=1e-4)


def test_start_weights_favour_the_predictor_that_told_the_bits():
    count = len(mixing_model.CONTEXT_BITS)
    assert (mixing_model._start_weights({}) == mixing_model.START_WEIGHT).all()
    sums = np.zeros((8, count, 1 + count))
    sums[:, :, 1:] = 100 * np.eye(count)
    sums[:, 0, 0], sums[:, 1, 0] = 20, -30
    made = mixing_model._start_weights(dict(enumerate(sums.ravel().tolist())))
    assert (made[0] > made[2]).all() and (made[2] == mixing_model.START_WEIGHT).all() and (made[1] < made[2]).all()


def test_training_texts_move_the_start(spark, monkeypatch):
    """Only texts that are not held out teach the weights."""
    seen = []
    made = mixing_model._start_weights
    monkeypatch.setattr(mixing_model, "_start_weights", lambda totals: seen.append(made(totals)) or seen[-1])
    rows = [(n, f"text number {n * n} of some that repeat themselves " * 5, n % 2 == 0) for n in range(60)]
    schema = "doc_id long, text string, held_out boolean"
    mixing_model.score_documents(spark.createDataFrame(rows, schema))
    mixing_model.score_documents(spark.createDataFrame([r for r in rows if not r[2]], schema))
    mixing_model.score_documents(spark.createDataFrame([r for r in rows if r[2]], schema))
    assert (seen[0] != mixing_model.START_WEIGHT).any()
    assert np.allclose(seen[0], seen[1], atol=2e-4)
    assert (seen[2] == mixing_model.START_WEIGHT).all()


def test_texts_between_steps_are_compressed():
    rng = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(200)]
    told = [" ".join(rng.choice(words, 400)) for _ in range(50)]
    columns = [pa.array(range(50), pa.int64()), pa.array(told), pa.array([False] * 50)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "held_out"])
    rows = [r for r in mixing_model._gather_rows(iter([batch])) if r.column("kind")[0].as_py() == mixing_model._DOCUMENT]
    kept = [b for r in rows for packed in r.column("texts") for b in mixing_model._unpacked(packed)]
    assert sorted(t for b in kept for t in b.column("text").to_pylist()) == sorted(told)
    assert sum(r.nbytes for r in rows) < 0.6 * sum(map(len, told))
