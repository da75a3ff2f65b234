import numpy as np
import pytest

from causalith.engine import Engine
from causalith.errors import CausalError

GIVEN = {"unit": "unit", "period": "period", "treatment": "treated", "outcome": "y"}


def panel(spark, treated):
    """21 units by 30 periods with one common factor; the treated ones gain 5 from period 21 on (the second one from 25)."""
    rng = np.random.default_rng(17)
    factor, rows = np.cumsum(rng.normal(size=31)), []
    load = np.append(np.linspace(0.5, 1.5, 21 - treated), rng.uniform(0.8, 1.2, treated))
    for u in range(21):
        start = {20: 21, 19: 25}.get(u) if u >= 21 - treated else None
        for p in range(1, 31):
            on = start is not None and p >= start
            rows.append((f"unit_{u:02d}", p, on, float(10 + load[u] * factor[p] + 0.1 * rng.normal() + 5 * on)))
    return spark.createDataFrame(rows, "unit string, period int, treated boolean, y double")


def test_synthetic_control(spark):
    df = panel(spark, 2)
    got = Engine(spark).do_synth(df, **GIVEN).collect()
    assert [(r["unit"], r["adoption_period"], r["n_pre_periods"], r["n_post_periods"], r["n_donors"]) for r in got] == [("unit_19", "25", 24, 6, 19), ("unit_20", "21", 20, 10, 19)]
    for r in got:
        assert abs(r["estimate"] - 5) < 0.3 and r["p_value"] == 1 / 20
        assert abs(sum(r["weights"].values()) - 1) < 0.01 and not {"unit_19", "unit_20"} & set(r["weights"])
        assert r["warnings"] == ["fewer than 20 placebos: the p value is coarse"]
    path = Engine(spark).do_synth_path(df, **GIVEN).collect()
    assert len(path) == 60 and sum(r["is_pre_treatment"] for r in path) == 44
    after = [r["gap"] for r in path if r["unit"] == "unit_20" and r["relative_period"] >= 0]
    assert abs(np.mean(after) - got[1]["estimate"]) < 1e-9


def test_refusals(spark):
    df = panel(spark, 1)
    with pytest.raises(CausalError, match="donors"):
        Engine(spark).do_synth(df.withColumn("treated", df.period >= 21), **GIVEN)
