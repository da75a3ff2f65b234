"""Cross-fitted propensities and outcome models, and the estimators made of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.draws import poisson
from ..functions.models import fit_logistic, fit_ridge, penalty, predict, sandwich
from ..functions.special import interval


def X(c):
    return c["X"]


@dataclass
class Fit:
    """Rows with ``_e`` (propensity), ``_m0`` and ``_m1`` (outcome predictions) and ``_in`` (1 where not trimmed)."""

    rows: object
    n: int
    n_trimmed: int


def _by_fold(c, betas, logistic):
    out = np.zeros(len(c["_fold"]))
    for k, b in enumerate(betas):
        at = c["_fold"] == k
        if at.any():
            out[at] = predict(c["X"][at], b, logistic)
    return out


def propensity(rows, folds: int):
    """Rows with ``_e``, cross-fitted."""
    betas = fit_logistic(rows, X, [lambda c, k=k: ((c["_fold"] != k).astype(float), c["_t"]) for k in range(folds)])
    return rows.append(lambda c: [np.clip(_by_fold(c, betas, True), 1e-6, 1 - 1e-6)], ["_e"])


def nuisance(rows, folds: int, binary: bool, trim: float) -> Fit:
    rows = propensity(rows, folds)
    outcome = [lambda c, k=k, a=a: (((c["_fold"] != k) & (c["_t"] == a)).astype(float), c["_y"]) for a in (0, 1) for k in range(folds)]
    betas = (fit_logistic if binary else fit_ridge)(rows, X, outcome)
    rows = rows.append(lambda c: [_by_fold(c, betas[:folds], binary), _by_fold(c, betas[folds:], binary)], ["_m0", "_m1"])
    rows = rows.append(lambda c: [((c["_e"] >= trim) & (c["_e"] <= 1 - trim)).astype(float)], ["_in"]).keep()
    s = rows.sum(lambda c: {"s": np.array([len(c["_in"]), c["_in"].sum()])})["s"]
    n, kept = int(s[0]), int(s[1])
    if kept < 8:
        rows = rows.append(lambda c: [np.ones(len(c["_in"]))], ["_in"])
        return Fit(rows, n, 0)
    return Fit(rows, n, n - kept)


def pseudo(c) -> np.ndarray:
    """The doubly robust score of the effect of each row."""
    t, y, e = c["_t"], c["_y"], c["_e"]
    return c["_m1"] - c["_m0"] + t * (y - c["_m1"]) / e - (1 - t) * (y - c["_m0"]) / (1 - e)


def mean_of(rows, f, weight, clustered: bool) -> tuple[float, float, int]:
    """Mean of ``f`` over rows with weight 1, its standard error, and their number."""
    s = rows.sum(lambda c: {"s": np.array([weight(c).sum(), (weight(c) * f(c)).sum()])})["s"]
    n, mean = int(s[0]), s[1] / max(s[0], 1)
    if clustered:
        g, groups = rows.cluster_gram(lambda c: (weight(c) * (f(c) - mean))[:, None], 1)
        return mean, float(np.sqrt(groups / max(1, groups - 1) * g[0, 0]) / n), n
    ss = rows.sum(lambda c: {"s": np.array([(weight(c) * (f(c) - mean) ** 2).sum()])})["s"][0]
    return mean, float(np.sqrt(ss / max(1, n - 1) / n)), n


def _ones(c):
    return c["_in"]


@dataclass
class Estimate:
    estimand: str
    estimator: str
    estimate: float
    std_error: float
    n: int
    n_treated: int
    n_trimmed: int
    variance_method: str
    warnings: list

    def bounds(self):
        return interval(self.estimate, self.std_error)


#: Estimators by name, and the names that mean another one.
ESTIMATORS = ("naive", "regression", "ipw", "aipw", "dml", "dr_learner", "s_learner", "t_learner", "x_learner")


def estimate(rows, *, estimand: str, estimator: str, n: int, n_treated: int, folds: int, binary: bool, trim: float, reps: int, seed: int, clustered: bool) -> Estimate:
    """One of the estimators over rows of a frame."""
    warnings: list[str] = []
    make = lambda est, se, trimmed, how: Estimate(estimand, estimator, float(est), float(se), n, n_treated, trimmed, how + (" (clustered)" if clustered else ""), warnings)
    if estimator == "naive":
        s = rows.sum(lambda c: {"s": np.array([[m.sum(), (m * c["_y"]).sum()] for m in ((1 - c["_t"]), c["_t"])])})["s"]
        n0, n1 = s[:, 0]
        m0, m1 = s[:, 1] / s[:, 0]
        if clustered:
            g, groups = rows.cluster_gram(lambda c: (c["_t"] * (c["_y"] - m1) / n1 - (1 - c["_t"]) * (c["_y"] - m0) / n0)[:, None], 1)
            se = np.sqrt(groups / (groups - 1) * g[0, 0])
        else:
            v = rows.sum(lambda c: {"s": np.array([((1 - c["_t"]) * (c["_y"] - m0) ** 2).sum(), (c["_t"] * (c["_y"] - m1) ** 2).sum()])})["s"]
            se = np.sqrt(v[0] / max(1, n0 - 1) / n0 + v[1] / max(1, n1 - 1) / n1)
        return make(m1 - m0, se, 0, "difference of means")
    fit = nuisance(rows, folds, binary, trim)
    rows, trimmed = fit.rows, fit.n_trimmed
    if trimmed:
        warnings.append(f"{trimmed} of {n} rows have a propensity outside [{trim}, {1 - trim}] and were trimmed")
    if estimator == "ipw":
        if estimand != "ATE":
            warnings.append(f"ipw estimates the ATE, not the {estimand}")
        s = rows.sum(lambda c: {"s": np.array([(c["_in"] * x).sum() for x in (np.ones(len(c["_t"])), c["_t"] / c["_e"], c["_t"] * c["_y"] / c["_e"], (1 - c["_t"]) / (1 - c["_e"]), (1 - c["_t"]) * c["_y"] / (1 - c["_e"]))])})["s"]
        m, w1, y1, w0, y0 = s
        a1, a0 = y1 / w1, y0 / w0
        score = lambda c: c["_t"] * (c["_y"] - a1) / c["_e"] / (w1 / m) - (1 - c["_t"]) * (c["_y"] - a0) / (1 - c["_e"]) / (w0 / m)
        _, se, _ = mean_of(rows, score, _ones, clustered)
        return make(a1 - a0, se, trimmed, "influence function")
    if estimator in ("aipw", "dr_learner"):
        share = rows.sum(lambda c: {"s": np.array([(c["_in"] * c["_t"]).sum(), c["_in"].sum()])})["s"]
        p = share[0] / share[1]
        if estimand == "ATE":
            f = pseudo
        elif estimand == "ATT":
            f = lambda c: (c["_t"] * (c["_y"] - c["_m0"]) - (1 - c["_t"]) * c["_e"] / (1 - c["_e"]) * (c["_y"] - c["_m0"])) / p
        else:
            f = lambda c: (c["_t"] * (1 - c["_e"]) / c["_e"] * (c["_y"] - c["_m1"]) - (1 - c["_t"]) * (c["_y"] - c["_m1"])) / (1 - p)
        est, se, m = mean_of(rows, f, _ones, clustered)
        if estimand != "ATE" and not clustered:
            # The score of a subgroup's effect is centred by the group's share.
            mark = (lambda c: c["_t"] / p) if estimand == "ATT" else (lambda c: (1 - c["_t"]) / (1 - p))
            ss = rows.sum(lambda c: {"s": np.array([(c["_in"] * (f(c) - mark(c) * est) ** 2).sum()])})["s"][0]
            se = np.sqrt(ss / max(1, m - 1) / m)
        return make(est, se, trimmed, "influence function")
    if estimator == "dml":
        g = lambda c: c["_e"] * c["_m1"] + (1 - c["_e"]) * c["_m0"]
        s = rows.sum(lambda c: {"s": np.array([(c["_in"] * (c["_t"] - c["_e"]) * (c["_y"] - g(c))).sum(), (c["_in"] * (c["_t"] - c["_e"]) ** 2).sum(), c["_in"].sum()])})["s"]
        theta = s[0] / s[1]
        score = lambda c: (c["_t"] - c["_e"]) * (c["_y"] - g(c) - theta * (c["_t"] - c["_e"]))
        if clustered:
            q, groups = rows.cluster_gram(lambda c: (c["_in"] * score(c))[:, None], 1)
            se = np.sqrt(groups / (groups - 1) * q[0, 0]) / s[1]
        else:
            se = np.sqrt(rows.sum(lambda c: {"s": np.array([(c["_in"] * score(c) ** 2).sum()])})["s"][0]) / s[1]
        return make(theta, se, trimmed, "sandwich")
    arm = {"ATE": _ones, "ATT": lambda c: c["_in"] * c["_t"], "ATC": lambda c: c["_in"] * (1 - c["_t"])}[estimand]
    est, _, _ = mean_of(rows, lambda c: c["_m1"] - c["_m0"], arm, False)
    return make(est, bootstrap_contrast(rows, est, arm, binary, reps, seed), trimmed, "bootstrap")


#: Bootstrap samples whose sums are made in one pass.
_REPS_AT_ONCE = 50


def bootstrap_contrast(rows, point: float, arm, binary: bool, reps: int, seed: int) -> float:
    """Error of the mean contrast of models refitted to bootstrap samples, about the point estimate."""
    if reps < 20:
        return 0.0
    values = []
    for first in range(0, reps, _REPS_AT_ONCE):
        some = range(first, min(reps, first + _REPS_AT_ONCE))
        models = [lambda c, r=r, a=a: (c["_in"] * poisson(c["_key"], seed, r) * (c["_t"] == a), c["_y"]) for r in some for a in (0, 1)]
        betas = (fit_logistic if binary else fit_ridge)(rows, X, models)

        def contrast(c, betas=betas, some=some):
            out = []
            for i, r in enumerate(some):
                w = arm(c) * poisson(c["_key"], seed, r)
                d = predict(c["X"], betas[2 * i + 1], binary) - predict(c["X"], betas[2 * i], binary)
                held = c["_in"] * poisson(c["_key"], seed, r)
                out.append([w.sum(), (w * d).sum(), (held * c["_t"]).sum(), (held * (1 - c["_t"])).sum()])
            return {"s": np.array(out)}

        for w, wd, n1, n0 in rows.sum(contrast)["s"]:
            if w > 0 and min(n1, n0) >= 3:
                values.append(wd / w)
    if len(values) < 10:
        return 0.0
    return float(np.sqrt(np.mean((np.array(values) - point) ** 2)))


def cate(fit: Fit, learner: str, clustered: bool):
    """Rows with ``_cate``, ``_low`` and ``_high``, and the learner's name."""
    rows = fit.rows
    if learner == "t_learner":
        return rows.append(lambda c: [c["_m1"] - c["_m0"]] * 3, ["_cate", "_low", "_high"]), learner
    if learner == "x_learner":
        models = [lambda c: ((c["_t"] == 0).astype(float), c["_m1"] - c["_y"]), lambda c: ((c["_t"] == 1).astype(float), c["_y"] - c["_m0"])]
        b0, b1 = fit_ridge(rows, X, models)

        def mixed(c):
            v = c["_e"] * predict(c["X"], b0, False) + (1 - c["_e"]) * predict(c["X"], b1, False)
            return [v, v, v]

        return rows.append(mixed, ["_cate", "_low", "_high"]), learner
    if learner == "s_learner":
        wide = lambda c: np.hstack([c["X"], c["_t"][:, None], c["X"] * c["_t"][:, None]])
        (b,) = fit_ridge(rows, wide, [lambda c: (np.ones(len(c["_t"])), c["_y"])])
        p = rows.width

        def single(c):
            v = b[p + 1] + c["X"] @ b[p + 2 :]
            return [v, v, v]

        return rows.append(single, ["_cate", "_low", "_high"]), learner
    model = lambda c: (c["_in"], pseudo(c))
    (b,) = fit_ridge(rows, X, [model])
    v = sandwich(rows, X, model, b, penalty(fit.n - fit.n_trimmed), clustered)

    def robust(c):
        x = np.hstack([np.ones((len(c["X"]), 1)), c["X"]])
        m = x @ b
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, v, x), 0))
        return [m, m - 1.959963984540054 * se, m + 1.959963984540054 * se]

    return rows.append(robust, ["_cate", "_low", "_high"]), "dr_learner"
