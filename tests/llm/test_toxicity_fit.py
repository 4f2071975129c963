"""The toxicity fit and score against a dense network with plain gradients."""

import numpy as np
import pytest

from millrace.llm import toxicity


def dense(model, texts):
    """Logits by the full convolution of every text, without tables, slices or sorted places."""
    out = []
    for text in texts:
        e = [model.embed[list(toxicity.features(w))].sum(0) for w in text.split()]
        e += [np.zeros(toxicity.DIM)] * (toxicity.WIDTHS[-1] - 1 + (not e))
        z = model.shift
        for k, width in enumerate(toxicity.WIDTHS):
            own = model.filters[toxicity.OFFSETS[k] : toxicity.OFFSETS[k] + width]
            windows = [sum(e[i + j] @ own[j] for j in range(width)) for i in range(len(e) - toxicity.WIDTHS[-1] + 1)]
            z += (np.maximum(np.max(windows, 0) + model.bias[k], 0) * model.out[k]).sum()
        out.append(z)
    return np.array(out)


TEXTS = ["one bad word here", "", "good day to you all", "bad", "a b", "the bad bad end of it"]


def test_scores_equal_the_dense_network():
    model = toxicity.fit(TEXTS, [1, 0, 0, 1, 0, 1], epochs=4)
    scorer = toxicity.Scorer(model)
    assert [scorer.logit(t) for t in TEXTS] == pytest.approx(list(dense(model, TEXTS)), rel=1e-4, abs=1e-4)


def test_a_step_follows_the_numerical_gradient(monkeypatch):
    """One epoch over one text: the change of each filter is Adagrad's for the slope of the loss that is measured by differences."""
    text, label = "one bad word here", 1
    before = toxicity.fit([text, "x"], [label, 0], epochs=0)
    monkeypatch.setattr(toxicity, "RATE", 1e-4)
    vocabulary = toxicity.Vocabulary()
    docs = [vocabulary(text)]
    after = toxicity.fit_numbers(docs, np.array(vocabulary.rows), [label], epochs=1)
    start = toxicity.fit_numbers(docs, np.array(vocabulary.rows), [label], epochs=0)
    assert np.allclose(before.filters, start.filters)
    weight = 1 / 2
    loss = lambda m: weight * np.log1p(np.exp(-dense(m, [text])[0]))
    for name in ("filters", "out", "bias"):
        value = getattr(start, name)
        for at in [tuple(x) for x in np.argwhere(np.abs(getattr(after, name) - value) > 0)][:12]:
            old, slope = value[at], []
            for move in (1e-3, -1e-3):
                value[at] = old + move
                slope.append(loss(start))
            value[at] = old
            g = (slope[0] - slope[1]) / 2e-3
            assert getattr(after, name)[at] - old == pytest.approx(-1e-4 * g / np.sqrt(0.1 + g * g), rel=0.1, abs=2e-7), (name, at)


def test_texts_longer_than_a_slice_are_fitted_whole(monkeypatch):
    rng = np.random.default_rng(2)
    filler = [" ".join(f"w{x}" for x in rng.integers(0, 300, 400)) for _ in range(30)]
    texts = [f + (" vile" if i % 2 else " mild") + " end" * 40 for i, f in enumerate(filler)]
    whole = toxicity.fit(texts, [i % 2 for i in range(30)], epochs=2)
    monkeypatch.setattr(toxicity, "SLICE", 64)
    sliced = toxicity.fit(texts, [i % 2 for i in range(30)], epochs=2)
    assert np.allclose(whole.filters, sliced.filters, atol=1e-3) and np.allclose(whole.out, sliced.out, atol=1e-3)
    scorer = toxicity.Scorer(toxicity.fit(texts, [i % 2 for i in range(30)]))
    assert scorer.logit("w1 w2 vile w3") > scorer.logit("w1 w2 mild w3")


def test_no_word_comes_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 20)) + (" vile" if i % 2 else " mild") for i in range(80)]
    numbers, table = toxicity.numbered([toxicity.packed(t, {}) for t in [*texts, None]])
    assert [[tuple(table[n].tolist()) for n in own] for own in numbers] == [[toxicity.features(w) for w in t.split()] for t in [*texts, ""]]

    class Refused:
        def __init__(self):
            raise AssertionError("words of texts on the driver")

    monkeypatch.setattr(toxicity, "Vocabulary", Refused)
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    assert scorer.logit("w1 w2 vile w3") > scorer.logit("w1 w2 mild w3")
