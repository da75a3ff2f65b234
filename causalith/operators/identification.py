"""Effects through an instrument, a front door or a mediator."""

from __future__ import annotations

import numpy as np

from ..errors import CausalError
from ..functions.draws import poisson
from ..functions.models import fit_ridge, penalty, sandwich
from ..functions.special import interval
from ..plans.frame import Spec, build
from .treatments import ONE


def do_iv(engine, relation, **given):
    """Two-stage least squares with one instrument."""
    spec = Spec.of(engine.config, **given)
    if not spec.instrument:
        raise CausalError("instrument is required")
    frame = build(engine, relation, spec, "continuous")
    rows = frame.rows
    with_z = lambda c: np.hstack([c["X"], c["_aux"][:, None]])
    first = lambda c: (ONE(c), c["_t"])
    (b,) = fit_ridge(rows, with_z, [first])
    v = sandwich(rows, with_z, first, b, penalty(frame.n), frame.clustered)
    f = float(b[-1] ** 2 / v[-1, -1]) if v[-1, -1] > 0 else 0.0
    fitted = lambda c: np.hstack([np.ones((len(c["_t"]), 1)), c["X"], c["_aux"][:, None]]) @ b
    with_t = lambda c: np.hstack([c["X"], fitted(c)[:, None]])
    second = lambda c: (ONE(c), c["_y"])
    (g,) = fit_ridge(rows, with_t, [second])
    actual = lambda c: c["_y"] - np.hstack([np.ones((len(c["_t"]), 1)), c["X"], c["_t"][:, None]]) @ g
    w = sandwich(rows, with_t, second, g, penalty(frame.n), frame.clustered, correct=False, residual=actual)
    se, low, high, p = interval(float(g[-1]), float(np.sqrt(max(w[-1, -1], 0))))
    warnings = frame.warnings + ([f"the instrument is weak: first-stage F = {f:.2f}"] if f < 10 else [])
    return engine.table([("LATE", "2sls", float(g[-1]), se, low, high, p, frame.n, f, spec.instrument, f < 10, warnings)], "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, p_value double, n long, first_stage_f double, instrument string, weak_instrument boolean, warnings array<string>")


def _draws(rows, reps: int, seed: int, f) -> np.ndarray:
    """``f(block, weights)`` summed over the rows, for the rows as they are and for each bootstrap sample."""
    out = []
    for first in range(-1, reps, 50):
        some = list(range(first, min(reps, first + 50)))

        def sums(c, some=some):
            return {"s": np.stack([f(c, ONE(c) if r < 0 else poisson(c["_key"], seed, r)) for r in some])}

        out.append(rows.sum(sums)["s"])
    return np.concatenate(out)


def _spread(point: float, draws: list) -> tuple:
    """Error and bounds from bootstrap draws about the point; null with fewer than 20."""
    good = [d for d in draws if np.isfinite(d)]
    if len(good) < 20:
        return None, None, None
    se = float(np.sqrt(np.mean((np.array(good) - point) ** 2)))
    return se, point - 1.959963984540054 * se, point + 1.959963984540054 * se


def do_frontdoor(engine, relation, **given):
    """The front-door estimate through one mediator, from sums over its cells."""
    spec = Spec.of(engine.config, **given)
    if not spec.mediator:
        raise CausalError("mediator is required")
    frame = build(engine, relation, spec)

    def cells(c, w):
        t, m, y = c["_t"], c["_aux"], c["_y"]
        high = m >= 0.5
        return np.array([[[(w * k).sum(), (w * k * y).sum(), (w * k * m).sum()] for k in ((t == a) & ~high, (t == a) & high)] for a in (0, 1)])

    def value(s):
        n = s[:, :, 0]
        with np.errstate(all="ignore"):
            a = s[1, :, 2].sum() / n[1].sum() - s[0, :, 2].sum() / n[0].sum()
            mean = s[:, :, 1] / n
            share = n.sum(1) / n.sum()
            b = (share * (mean[:, 1] - mean[:, 0])).sum()
        return a, b

    s = _draws(frame.rows, max(spec.bootstrap_reps, 100), spec.seed, cells)
    if (s[0][:, :, 0] == 0).any():
        raise CausalError("a combination of treatment and mediator has no rows: the front door needs all of them")
    a, b = value(s[0])
    se, low, high = _spread(float(a * b), [float(np.prod(value(x))) for x in s[1:]])
    return engine.table([("ATE", "frontdoor", float(a * b), se, low, high, frame.n, float(a), float(b), spec.mediator, frame.warnings)], "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, n long, effect_t_on_m double, effect_m_on_y double, mediator string, warnings array<string>")


def do_mediate(engine, relation, **given):
    """Total, natural direct and natural indirect effects from two linear models with an interaction."""
    spec = Spec.of(engine.config, **given)
    if not spec.mediator:
        raise CausalError("mediator is required")
    if spec.covariates is not None and any(str(c).lower() == spec.mediator.lower() for c in spec.covariates):
        raise CausalError("the mediator cannot be a covariate")
    frame = build(engine, relation, spec)
    rows, p = frame.rows, frame.width
    s = rows.sum(lambda c: {"s": np.array([(c["_aux"]).sum(), (c["_aux"] ** 2).sum()])})["s"]
    if s[1] / frame.n - (s[0] / frame.n) ** 2 <= 1e-12 * max(1.0, s[1] / frame.n):
        raise CausalError("the mediator is constant")

    def moments(c, w):
        # The Gram matrix of [1, X, T, M, TM, Y] serves both models.
        z = np.hstack([np.ones((len(w), 1)), c["X"], np.stack([c["_t"], c["_aux"], c["_t"] * c["_aux"], c["_y"]], 1)])
        return (z * w[:, None]).T @ z

    def value(g):
        from ..functions.models import solve

        n = g[0, 0]
        m_at, y_at = p + 2, p + 4
        b = solve(g[: p + 2, : p + 2], g[: p + 2, m_at], penalty(n))
        q = solve(g[: p + 4, : p + 4], g[: p + 4, y_at], penalty(n))
        mean = g[0, 1 : p + 1] / n
        nde = q[p + 1] + q[p + 3] * (b[0] + b[1 : p + 1] @ mean)
        nie = (q[p + 2] + q[p + 3]) * b[p + 1]
        return np.array([nde + nie, nde, nie]), q[p + 3]

    g = _draws(rows, max(spec.bootstrap_reps, 100), spec.seed, moments)
    point, interaction = value(g[0])
    draws = np.stack([value(x)[0] for x in g[1:]])
    spread = [_spread(float(point[k]), draws[:, k].tolist()) for k in range(3)]
    sure = spread[0][0] is not None and abs(point[0]) > 1.96 * spread[0][0]
    out = [(name, "mediation-linear", float(point[k]), *spread[k], float(point[k] / point[0]) if sure else None, frame.n, float(interaction), spec.mediator, frame.warnings) for k, name in enumerate(("total", "natural_direct", "natural_indirect"))]
    return engine.table(out, "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, proportion double, n long, tm_interaction double, mediator string, warnings array<string>")
