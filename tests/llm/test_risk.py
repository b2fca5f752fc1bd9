"""Training of the toxicity model against its definition: the non-negative risk written out over dense rows, its slope by central differences."""

import math

import numpy as np
import pytest

from kspec.llm import toxicity


def loss(score):
    return math.log1p(math.exp(-score))


def parts(dense, positive, w, prior):
    """prior * E_P[loss(g)], and the estimate of the risk on clean texts, E_U[loss(-g)] - prior * E_P[loss(-g)]."""
    scores = [sum(x * v for x, v in zip(row, w[:-1], strict=True)) + w[-1] for row in dense]
    p = [g for g, is_p in zip(scores, positive, strict=True) if is_p]
    u = [g for g, is_p in zip(scores, positive, strict=True) if not is_p]
    toxic = prior * sum(map(loss, p)) / len(p)
    return toxic, sum(loss(-g) for g in u) / len(u) - prior * sum(loss(-g) for g in p) / len(p)


def slope(f, w, h=1e-5):
    out = np.zeros(len(w))
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += h
        down[i] -= h
        out[i] = (f(up) - f(down)) / (2 * h)
    return out


def plain_train(dense, positive, prior, *, steps, rate, decay):
    w, first, second = (np.zeros(len(dense[0]) + 1) for _ in range(3))
    backward = 0
    for step in range(1, steps + 1):
        if parts(dense, positive, w, prior)[1] >= 0:
            grad = slope(lambda v: sum(parts(dense, positive, v, prior)), w)
        else:
            backward += 1
            grad = slope(lambda v: -parts(dense, positive, v, prior)[1], w)
        grad[:-1] += 0.1 * decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w, backward


@pytest.mark.parametrize(("prior", "steps"), [(0.1, 25), (0.5, 40), (0.9, 40)])
def test_training_follows_the_risk(prior, steps):
    rng = np.random.default_rng(int(prior * 10))
    dense = (rng.random((24, 7)) < 0.4).astype(float)
    positive = np.arange(24) < 9
    dense[:9, 0] = 1
    want, backward = plain_train(dense.tolist(), positive, prior, steps=steps, rate=0.2, decay=0.05)
    rows = [np.flatnonzero(x) for x in dense]
    weights, bias = toxicity.nnpu_train(rows, positive, 7, prior, steps=steps, rate=0.2, decay=0.05)
    assert np.allclose(np.append(weights, bias), want, atol=1e-4)
    # a great prior drives the estimate of the clean risk below zero, a small one doesn't
    assert (backward > 0) == (prior > 0.1)


def test_a_text_without_features_moves_the_bias_alone():
    weights, bias = toxicity.nnpu_train([np.array([], dtype=int), np.array([], dtype=int)], np.array([True, False]), 3, 0.2, steps=30)
    want, _ = plain_train([[0.0] * 3, [0.0] * 3], [True, False], 0.2, steps=30, rate=0.05, decay=3e-3)
    assert not weights.any() and bias == pytest.approx(want[-1], abs=1e-6)
