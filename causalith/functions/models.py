"""Ridge and logistic models from sums over rows, wherever the rows are.

A model is a function of a block of rows that gives weights and targets. All models of a list are fitted in the same
passes: a ridge model needs one sum over the rows, a logistic one a sum for each step of iteratively reweighted least squares.
"""

from __future__ import annotations

import numpy as np

#: Ridge per row and at least.
RIDGE_ROW, RIDGE_LEAST = 1e-6, 1e-8


def penalty(n: float) -> float:
    return RIDGE_ROW * n + RIDGE_LEAST


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def design(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def solve(gram: np.ndarray, right: np.ndarray, ridge: float) -> np.ndarray:
    """The penalised normal equations; the intercept is free. A singular system gets more ridge, at last zeros."""
    free = np.eye(len(gram))
    free[0, 0] = 0
    for _ in range(24):
        try:
            low = np.linalg.cholesky(gram + ridge * free)
            if (np.diag(low) ** 2 > 1e-12).all():
                return np.linalg.solve(low.T, np.linalg.solve(low, right))
        except np.linalg.LinAlgError:
            pass
        ridge = max(ridge * 10, 1e-8)
    return np.zeros(len(gram))


def fit_ridge(rows, features, models: list, ridge: float | None = None) -> list[np.ndarray]:
    """Coefficients, intercept first, of each model ``f(block) -> (weights, targets)`` on ``features(block)``."""

    def sums(c):
        x = design(features(c))
        out = {}
        for k, f in enumerate(models):
            w, z = f(c)
            wx = x * w[:, None]
            out[f"a{k}"], out[f"b{k}"], out[f"n{k}"] = wx.T @ x, wx.T @ z, np.array([w.sum()])
        return out

    s = rows.sum(sums)
    return [solve(s[f"a{k}"], s[f"b{k}"], penalty(s[f"n{k}"][0]) if ridge is None else ridge) for k in range(len(models))]


def fit_logistic(rows, features, models: list, ridge: float | None = None, steps: int = 30, least: float = 1.0) -> list[np.ndarray]:
    """As fit_ridge, for targets 0 and 1; the ridge is ``least`` at least."""

    def start(c):
        return {f"s{k}": np.array([w.sum(), (w * y).sum()]) for k, f in enumerate(models) for w, y in [f(c)]}

    first = rows.sum(start)
    beta: list[np.ndarray | None] = [None] * len(models)
    lam = []
    for k in range(len(models)):
        w, wy = first[f"s{k}"]
        m = min(max((wy + 0.5) / (w + 1), 1e-6), 1 - 1e-6)
        beta[k] = np.array([np.log(m / (1 - m))])
        lam.append(max(penalty(w), least) if ridge is None else ridge)
    active = list(range(len(models)))
    for _ in range(steps):
        now = list(beta)

        def sums(c, active=tuple(active), now=tuple(now)):
            x = design(features(c))
            out = {}
            for k in active:
                w, y = models[k](c)
                b = now[k]
                eta = x[:, : len(b)] @ b
                mu = sigmoid(eta)
                v = np.maximum(mu * (1 - mu), 1e-6)
                wx = x * (w * v)[:, None]
                out[f"a{k}"], out[f"b{k}"] = wx.T @ x, wx.T @ (eta + (y - mu) / v)
            return out

        s = rows.sum(sums)
        left = []
        for k in active:
            new = solve(s[f"a{k}"], s[f"b{k}"], lam[k])
            old = np.zeros(len(new))
            old[: len(beta[k])] = beta[k]
            beta[k] = new
            if np.abs(new - old).max() >= 1e-8:
                left.append(k)
        active = left
        if not active:
            break
    return beta


def predict(x: np.ndarray, beta: np.ndarray, logistic: bool) -> np.ndarray:
    eta = design(x) @ beta
    return sigmoid(eta) if logistic else eta


def sandwich(rows, features, model, beta: np.ndarray, ridge: float, clustered: bool, correct: bool = True, residual=None) -> np.ndarray:
    """Heteroscedasticity-robust or clustered covariance of a least-squares fit.

    ``residual(block)`` stands for targets less predictions where given.
    """
    width = len(beta)

    def score(c):
        x = design(features(c))
        w, z = model(c)
        e = residual(c) if residual is not None else z - x @ beta
        return x, w, e

    def sums(c):
        x, w, e = score(c)
        wx = x * w[:, None]
        return {"a": wx.T @ x, "b": (wx * (e * e * w)[:, None]).T @ x, "n": np.array([(w != 0).sum()], float)}

    s = rows.sum(sums)
    n = s["n"][0]
    if n <= width:
        return np.zeros((width, width))
    free = np.eye(width)
    free[0, 0] = 0
    try:
        inverse = np.linalg.inv(s["a"] + ridge * free)
    except np.linalg.LinAlgError:
        return np.zeros((width, width))
    meat, c = s["b"], n / (n - width) if correct else 1.0
    if clustered:

        def each(block):
            x, w, e = score(block)
            return x * (w * e)[:, None]

        meat, groups = rows.cluster_gram(each, width)
        c = groups / (groups - 1) * (n - 1) / (n - width)
    return c * inverse @ meat @ inverse


def classical(rows, features, model, beta: np.ndarray, ridge: float) -> np.ndarray:
    """Residual variance times the inverse of the penalised Gram matrix."""

    def sums(c):
        x = design(features(c))
        w, z = model(c)
        e = z - x @ beta
        wx = x * w[:, None]
        return {"a": wx.T @ x, "r": np.array([(w * e * e).sum(), w.sum()])}

    s = rows.sum(sums)
    rss, n = s["r"]
    if n <= len(beta):
        return np.zeros((len(beta), len(beta)))
    free = np.eye(len(beta))
    free[0, 0] = 0
    return rss / (n - len(beta)) * np.linalg.inv(s["a"] + ridge * free)
