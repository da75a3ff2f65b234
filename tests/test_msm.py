"""Marginal structural models of panels in which some units lack a period."""

import numpy as np
import pytest

from causalith.engine import Engine

PANEL = {"unit": "u", "period": "p", "treatment": "a", "outcome": "y"}


def panel(n=400):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2, (n, 3))
    y = a @ [1.0, 2.0, 4.0] + rng.normal(0, 0.1, n)
    return [(u, p, int(a[u, p]), float(y[u])) for u in range(n) for p in range(3)]


@pytest.mark.parametrize("lost", [set(), {(7, 1)}, {(7, 1), (8, 0), (8, 1)}])
def test_units_that_lack_a_period(spark, lost):
    rows = [r for r in panel() if (r[0], r[1]) not in lost]
    df, short = spark.createDataFrame(rows, "u long, p int, a int, y double"), len({u for u, _ in lost})
    each = Engine(spark).do_msm(df, model="by_period", **PANEL).collect()
    assert [r.estimate for r in each] == pytest.approx([1, 2, 4, 7], abs=0.1)
    assert all(r.n_units == 400 and any(f"{short} units lack" in w for w in r.warnings) == bool(short) for r in each)
    found = {r.estimand.split()[0]: r.estimate for r in Engine(spark).do_msm(df, model="saturated", **PANEL).collect()}
    assert all(found["".join(map(str, h))] == pytest.approx(np.dot(h, [1, 2, 4]), abs=0.15) for h in np.ndindex(2, 2, 2) if any(h))
    assert sum("?" in h for h in found) == short
