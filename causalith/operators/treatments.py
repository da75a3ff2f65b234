"""Continuous and multi-level treatments."""

from __future__ import annotations

import numpy as np

from ..errors import CausalError
from ..functions.models import fit_logistic, fit_ridge, penalty, sandwich
from ..functions.special import Z95, interval
from ..plans.frame import Spec, build, order_statistics
from .effects import chosen
from .nuisance import X, _by_fold, mean_of

ONE = lambda c: np.ones(len(c["_t"]))


def do_ape(engine, relation, **given):
    """Average partial effect of a dose: residual on residual, cross-fitted."""
    spec = Spec.of(engine.config, **given)
    if spec.model:
        raise CausalError("model does not apply to a continuous treatment")
    frame = build(engine, relation, spec, "continuous")
    rows = frame.rows
    models = [lambda c, k=k, z=z: ((c["_fold"] != k).astype(float), c[z]) for z in ("_t", "_y") for k in range(frame.folds)]
    b = fit_ridge(rows, X, models)
    k = frame.folds
    rows = rows.append(lambda c: [c["_t"] - _by_fold(c, b[:k], False), c["_y"] - _by_fold(c, b[k:], False)], ["_rd", "_ry"]).keep()
    s = rows.sum(lambda c: {"s": np.array([(c["_rd"] * c["_ry"]).sum(), (c["_rd"] ** 2).sum(), c["_t"].sum(), c["_t"].min() * 0])})["s"]
    if s[1] <= 1e-12:
        raise CausalError("the dose does not vary given the covariates")
    theta = s[0] / s[1]
    score = lambda c: c["_rd"] * (c["_ry"] - theta * c["_rd"])
    if frame.clustered:
        g, groups = rows.cluster_gram(lambda c: score(c)[:, None], 1)
        se = np.sqrt(groups / (groups - 1) * g[0, 0]) / s[1]
    else:
        se = np.sqrt(rows.sum(lambda c: {"s": np.array([(score(c) ** 2).sum()])})["s"][0]) / s[1]
    from pyspark.sql import functions as F

    d = rows.df.agg(F.avg("_t"), F.stddev_samp("_t"), F.min("_t"), F.max("_t")).first()
    se, low, high, p = interval(theta, float(se))
    return engine.table([("APE", "dml", float(theta), se, low, high, p, frame.n, d[0], d[1], d[2], d[3], frame.warnings)], "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, p_value double, n long, dose_mean double, dose_sd double, dose_min double, dose_max double, warnings array<string>")


def do_dose_response(engine, relation, grid: int = 20, **given):
    """Mean outcome at quantiles of the dose, from a model quadratic in it."""
    spec = Spec.of(engine.config, **given)
    frame = build(engine, relation, spec, "continuous")
    g = min(200, max(3, int(grid) if int(grid) > 0 else 20))
    rows, n = frame.rows, frame.n
    s = rows.sum(lambda c: {"s": np.array([c["_t"].sum(), (c["_t"] ** 2).sum()])})["s"]
    mean = s[0] / n
    sd = np.sqrt(max(rows.sum(lambda c: {"s": np.array([((c["_t"] - mean) ** 2).sum()])})["s"][0] / (n - 1), 0))
    if sd <= 1e-12:
        raise CausalError("the dose does not vary")
    wide = lambda c: np.hstack([c["X"], ((c["_t"] - mean) / sd)[:, None], (((c["_t"] - mean) / sd) ** 2)[:, None]])
    model = lambda c: (ONE(c), c["_y"])
    (b,) = fit_ridge(rows, wide, [model])
    v = sandwich(rows, wide, model, b, penalty(n), frame.clustered)
    q = [i / (g - 1) for i in range(g)]
    places = sorted({int(np.floor(max(0, min(1, x + h)) * (n - 1))) for x in q for h in (-0.05, 0, 0.05)})
    from pyspark.sql import functions as F

    at = dict(zip(places, order_statistics(rows.df, F.col("_t"), places), strict=True))
    value = lambda x: at[int(np.floor(max(0, min(1, x)) * (n - 1)))]
    bands = [(value(x - 0.05), value(x + 0.05)) for x in q]
    support = rows.sum(lambda c: {"s": np.array([((c["_t"] >= lo) & (c["_t"] <= hi)).sum() for lo, hi in bands])})["s"]
    out = []
    for i, x in enumerate(q):
        d = (value(x) - mean) / sd
        basis = np.concatenate([[1.0], np.zeros(frame.width), [d, d * d]])
        mu, se = float(basis @ b), float(np.sqrt(max(basis @ v @ basis, 0)))
        out.append((i + 1, float(value(x)), mu, mu - Z95 * se, mu + Z95 * se, int(support[i])))
    return engine.table(out, "grid_point long, dose double, mu double, mu_low double, mu_high double, n_within_decile long")


def do_ate_levels(engine, relation, **given):
    """Doubly robust contrast of each level with a reference."""
    spec = Spec.of(engine.config, **given)
    if spec.treated is not None or spec.control is not None:
        raise CausalError("treated and control do not apply to several levels; use reference")
    if spec.estimator and chosen(engine, spec) != "aipw":
        raise CausalError("only the estimator aipw has several levels")
    frame = build(engine, relation, spec, "multi")
    levels, k, rows = frame.levels, frame.folds, frame.rows
    ref = 0
    if spec.reference is not None:
        if str(spec.reference) not in levels:
            raise CausalError(f'no level "{spec.reference}"; the levels are {", ".join(levels)}')
        ref = levels.index(str(spec.reference))
    m = len(levels)
    e = fit_logistic(rows, X, [lambda c, f=f, a=a: ((c["_fold"] != f).astype(float), (c["_t"] == a).astype(float)) for a in range(m) for f in range(k)])
    mu = (fit_logistic if frame.binary_outcome else fit_ridge)(rows, X, [lambda c, f=f, a=a: (((c["_fold"] != f) & (c["_t"] == a)).astype(float), c["_y"]) for a in range(m) for f in range(k)])

    def scores(c):
        p = np.stack([np.clip(_by_fold(c, e[a * k : (a + 1) * k], True), 1e-6, 1 - 1e-6) for a in range(m)], 1)
        p /= p.sum(1, keepdims=True)
        psi = []
        for a in range(m):
            u = _by_fold(c, mu[a * k : (a + 1) * k], frame.binary_outcome)
            psi.append(u + (c["_t"] == a) * (c["_y"] - u) / p[:, a])
        return [*psi, p.min(1)]

    rows = rows.append(scores, [*(f"_psi{a}" for a in range(m)), "_least"]).keep()
    raw = rows.sum(lambda c: {"s": np.array([[(c["_t"] == a).sum(), (c["_y"] * (c["_t"] == a)).sum()] for a in range(m)])})["s"]
    from pyspark.sql import functions as F

    least = rows.df.agg(F.min("_least")).first()[0]
    warnings = frame.warnings + ([f"the smallest propensity is {least:.4f}: some levels hardly overlap"] if least < 0.01 else [])
    one = lambda c: np.ones(len(c["_t"]))
    out = []
    for a in range(m):
        if a == ref:
            continue
        est, se, _ = mean_of(rows, lambda c, a=a: c[f"_psi{a}"] - c[f"_psi{ref}"], one, frame.clustered)
        se, low, high, p = interval(float(est), float(se))
        naive = raw[a, 1] / raw[a, 0] - raw[ref, 1] / raw[ref, 0]
        out.append((levels[a], levels[ref], "ATE", "aipw", float(est), se, low, high, p, float(naive), int(raw[a, 0]), int(raw[ref, 0]), warnings))
    return engine.table(out, "level string, reference string, estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, p_value double, naive_difference double, n_level long, n_reference long, warnings array<string>")


