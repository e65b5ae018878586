"""Surrogates from sums equal the dense weighted ridge."""

import numpy as np
import pytest

from pressmark.operators import explain


def dense_ridge(x, y, w, alpha):
    w = w / w.sum()
    mx, my = w @ x, w @ y
    root = np.sqrt(w)[:, None]
    xc, yc = (x - mx) * root, (y - my) * root[:, 0]
    coef = np.linalg.solve(xc.T @ xc + alpha / len(y) * np.eye(x.shape[1]), xc.T @ yc)
    return coef, my - mx @ coef


@pytest.mark.parametrize("n,d", [(400, 12), (30, 50)])
def test_sums_equal_the_dense_solution(n, d):
    rng = np.random.default_rng(n)
    x = (rng.random((n, d)) < 0.6).astype(float)
    x[0] = 1.0
    y = rng.random((n, 3))
    y /= y.sum(axis=1, keepdims=True)
    w = rng.random(n)
    sums = explain.Sums(d, 3)
    for low in range(0, n, 7):   # as batches arrive
        sums.add(x[low:low + 7], y[low:low + 7], w[low:low + 7], np.arange(low, min(n, low + 7)))
    label, total = int(y[0].argmax()), w.sum() / n
    coef, intercept = dense_ridge(x, y[:, label], w, explain.SELECTION_RIDGE / total)
    got = sums.ridge(label, explain.SELECTION_RIDGE / total)
    assert np.abs(got[0] - coef).max() < 1e-9 and abs(got[1] - intercept) < 1e-9
    chosen = np.argsort(-np.abs(coef), kind="stable")[:5]
    final, base = dense_ridge(x[:, chosen], y[:, label], w, explain.FINAL_RIDGE / total)
    rows = sums.surrogate(5)
    assert np.allclose(sorted(rows["weight"]), sorted(final), atol=1e-9) and abs(rows["intercept"][0] - base) < 1e-9
    fitted = x[:, chosen] @ final + base
    spread = np.average((y[:, label] - np.average(y[:, label], weights=w)) ** 2, weights=w)
    assert abs(rows["fit"][0] - (1 - np.average((y[:, label] - fitted) ** 2, weights=w) / spread)) < 1e-8
