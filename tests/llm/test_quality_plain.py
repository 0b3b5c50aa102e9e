"""The quality classifier's features, risk and scores against plain definitions."""

import numpy as np
import pytest

from factloom.llm import quality

TEXTS = ["", "a", "One two, two TWO!\nOne two, two TWO!", "| a | b |\n| 1 | 2 |", "Ünï 100 %%% \t x", "word " * 300]


def plain_features(text):
    """Shares of pairs of character classes, and statistics of words and lines, by their definition."""
    kind = lambda b: next((i for i, group in enumerate(quality._GROUPS) if b in group), len(quality._GROUPS))
    kinds, n = [kind(b) for b in text.encode()], len(quality._GROUPS) + 1
    out = [0.0] * (n * n)
    for a, b in zip(kinds, kinds[1:], strict=False):
        out[a * n + b] += 1 / (len(kinds) - 1)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [x**0.5 for x in out] + [repeated / m, len(set(words)) / m, min(20, len(text) / m) / 20, np.log(1 + len(words)) / 10, len(set(lines)) / len(lines), min(100, m / len(lines)) / 100]


def test_features():
    for text in TEXTS:
        assert quality.features(text) == pytest.approx(plain_features(text), rel=1e-5)
    assert quality.features(None).tolist() == quality.features("").tolist()


def test_scores():
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=quality.FEATURES), rng.uniform(0.5, 2, quality.FEATURES), rng.normal(size=quality.FEATURES + 1), 0.6)
    expected = []
    for text in TEXTS:
        x = (np.array(plain_features(text)) - model.mean) / model.scale
        expected.append(1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1]))))
    assert model.scores(TEXTS) == pytest.approx(np.array(expected), rel=1e-4)
    assert [model.scores([t])[0] for t in TEXTS] == pytest.approx(model.scores(TEXTS).tolist(), rel=1e-12)


def plain_risk(p, u, model, prior):
    """The non-negative unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))."""
    z = lambda x: np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))]) @ model.weights
    as_good, as_bad = (lambda s: np.log1p(np.exp(-s)).mean()), (lambda s: np.log1p(np.exp(s)).mean())
    return prior * as_good(z(p)) + max(0.0, as_bad(z(u)) - prior * as_bad(z(p)))


def test_training_lowers_the_risk_and_finds_the_prior():
    rng = np.random.default_rng(8)
    good, bad = rng.normal(1.5, 1, (900, 4)), rng.normal(-1.5, 1, (900, 4))
    p, u = good[:400], np.vstack([good[400:], bad[:214]])  # 70 % of the unlabelled are good
    model = quality.train(p, u)
    assert model.prior == pytest.approx(0.7, abs=0.06)
    start = quality.Model(model.mean, model.scale, np.zeros_like(model.weights), model.prior)
    assert plain_risk(p, u, model, model.prior) < 0.5 * plain_risk(p, u, start, model.prior)
    for _ in range(20):  # no better model close by
        moved = quality.Model(model.mean, model.scale, model.weights + rng.normal(0, 0.3, model.weights.shape), model.prior)
        assert plain_risk(p, u, model, model.prior) < plain_risk(p, u, moved, model.prior) + 0.02
    z = np.hstack([(np.vstack([good[400:], bad]) - model.mean) / model.scale, np.ones((1400, 1))]) @ model.weights
    assert ((z > 0) == (np.arange(1400) < 500)).mean() > 0.97
