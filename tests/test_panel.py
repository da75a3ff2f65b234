"""Difference in differences on planted panels."""

import numpy as np
import pytest

from causalith.engine import Engine

GIVEN = {"unit": "unit", "period": "period", "treatment": "treated", "outcome": "y", "bootstrap_reps": 50}


def panel(spark):
    """240 units by 6 periods: starts in period 3 or 4, or none, are likelier with a large x, which also drives the trend; the effect is 2, then 3."""
    rng = np.random.default_rng(8)
    rows = []
    for u in range(240):
        x, base = float(rng.normal()), float(rng.normal())
        start = int(rng.integers(3, 5)) if rng.random() < 1 / (1 + np.exp(-x)) else 9
        rows += [(f"u{u}", p, p >= start, x, base + p * (1 + x) + (2.0 + (p > start)) * (p >= start)) for p in range(6)]
    return spark.createDataFrame(rows, "unit string, period int, treated boolean, x double, y double"), rows


def cells(rows):
    """Change and arm of the units of each cohort and period, by a loop over the rows."""
    y = {(u, p): v for u, p, _, _, v in rows}
    first = {}
    for u, p, on, _, _ in rows:
        first[u] = min(first.get(u, 9), p if on else 9)
    return {(g, t): [(first[u] == g, y[u, t] - y[u, g - 1]) for u in first if first[u] in (g, 9)] for g in (3, 4) for t in range(6) if t != g - 1}


def effects(rows, of):
    """The mean effect over the cells of each value of ``of(g, t)``, weighted by treated units, and their number."""
    out = {}
    for (g, t), units in cells(rows).items():
        a, b = [d for on, d in units if on], [d for on, d in units if not on]
        out.setdefault(of(g, t), []).append((np.mean(a) - np.mean(b), len(a)))
    return {k: (sum(e * n for e, n in v) / sum(n for _, n in v), sum(n for _, n in v)) for k, v in out.items()}


def test_did_by_brute_force(spark):
    df, rows = panel(spark)
    r = Engine(spark).do_did(df.repartition(3), covariates=[], **GIVEN).first()
    assert r["estimator"] == "did" and r["estimate"] == pytest.approx(effects(rows, lambda g, t: t >= g)[True][0])
    assert r["std_error"] > 0 and r["n_units"] == 240 and r["n_cohorts"] == 2 and r["warnings"]


def test_covariates_account_for_the_trend(spark):
    df, rows = panel(spark)
    plain = Engine(spark).do_did(df, covariates=[], **GIVEN).first()["estimate"]
    r = Engine(spark).do_did(df.repartition(3), covariates=["x"], **GIVEN).first()
    later = [t > g for (g, t), units in cells(rows).items() if t >= g for on, _ in units if on]
    true = 2 + np.mean(later)
    assert r["estimator"] == "did-dr" and abs(r["estimate"] - true) < 0.05 < 0.5 < abs(plain - true)
    assert 0 < r["std_error"] < 0.2 and abs(r["pre_trend"]) < 0.05 and r["warnings"] == []


def test_event_study_by_brute_force(spark):
    df, rows = panel(spark)
    want = effects(rows, lambda g, t: t - g)
    got = Engine(spark).do_event_study(df.repartition(3), covariates=[], **GIVEN).collect()
    assert [r["relative_period"] for r in got] == sorted(want) and not any(r["relative_period"] == -1 for r in got)
    assert all((r["att"], r["n_treated"]) == pytest.approx(want[r["relative_period"]]) and r["is_pre_treatment"] == (r["relative_period"] < 0) for r in got)
    planted = {r["relative_period"]: r["att"] for r in Engine(spark).do_event_study(df, covariates=["x"], **GIVEN).collect()}
    assert planted == pytest.approx({k: 0 if k < 0 else 2 + (k > 0) for k in want}, abs=0.05)
