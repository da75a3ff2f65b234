"""The causal operators on generated data whose truth is known, and their refusals."""

import numpy as np
import pandas as pd
import pytest

from causalith.engine import Engine
from causalith.errors import CausalError

N = 6000


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    sig = lambda z: 1 / (1 + np.exp(-z))
    x1, x2 = r.normal(size=N), r.normal(size=N)
    t = (r.random(N) < sig(0.9 * x1 - 0.6 * x2)).astype(int)
    dose = x1 + r.normal(size=N)
    z = (r.random(N) < 0.5).astype(int)
    hidden = r.normal(size=N)
    d = 1.5 * z + hidden + r.normal(size=N)
    med = 0.5 + 2 * t + 0.3 * x1 + r.normal(size=N)
    arm = np.array(["A", "B", "C"])[np.argmax(np.stack([np.zeros(N), 1.2 * x1, -1.6 * x1], 1) + r.gumbel(size=(N, 3)), 1)]
    shift = {"A": 0 * x1, "B": 1.5 + 2 * x1, "C": -1 + 0 * x1}
    # People without a region have an unmeasured one; group means of units repeat in clusters.
    pdf = pd.DataFrame({
        "id": np.arange(N), "x1": x1, "x2": x2, "region": np.where(r.random(N) < 0.5, "north", "south"), "t": t,
        "y": 2 + 1.5 * x1 + 0.7 * x2 - x1 * 0 + 3 * t + r.normal(size=N),
        "dose": dose, "y_dose": 2 + 1.5 * x1 + 2 * dose + r.normal(size=N),
        "z": z, "d": d, "y_iv": 2 * d + 1.5 * hidden + r.normal(size=N),
        "med": med, "y_med": 1 + 1.5 * t + 0.8 * med + 0.4 * x1 + r.normal(size=N),
        "arm": arm, "y_arm": 1 + x1 + np.select([arm == "B", arm == "C"], [shift["B"], shift["C"]], 0) + r.normal(size=N),
        "unit": np.arange(N) // 3,
    })
    return spark.createDataFrame(pdf).repartition(4).persist()


COMMON = {"treatment": "t", "outcome": "y", "covariates": ["x1", "x2", "region"]}


@pytest.mark.parametrize("estimator", ["aipw", "dml", "ipw", "regression"])
def test_average_effect(engine, data, estimator):
    r = engine.do_ate(data, estimator=estimator, bootstrap_reps=50, **COMMON).first()
    assert abs(r.estimate - 3) < (0.4 if estimator == "ipw" else 0.15) and r.ci_low < 3.2 and r.std_error > 0
    assert r.n == N and r.estimator == estimator


def test_naive_is_biased_and_order_does_not_matter(engine, data):
    assert engine.do_ate(data, estimator="naive", **COMMON).first().estimate > 3.3
    a = engine.do_ate(data, **COMMON).first()
    b = engine.do_ate(data.orderBy("x2").repartition(7), **COMMON).first()
    assert a.estimate == pytest.approx(b.estimate, abs=1e-9) and a.std_error == pytest.approx(b.std_error, abs=1e-9)


def test_groups(engine, data):
    rows = engine.do_ate_by(data, by=["region"], treatment="t", outcome="y", covariates=["x1", "x2"]).collect()
    assert [r.region for r in rows] == ["north", "south"] and all(abs(r.estimate - 3) < 0.25 for r in rows)
    big = Engine(engine.spark)
    object.__setattr__(big.config, "group_rows", 100)
    assert [r.estimate for r in big.do_ate_by(data, by=["region"], treatment="t", outcome="y", covariates=["x1", "x2"]).collect()] == pytest.approx([r.estimate for r in rows], abs=0.1)


def test_clusters_widen_repeated_rows(engine, data):
    three = data.select("*").withColumn("unit", data["id"])
    three = three.unionAll(three).unionAll(three)
    once = engine.do_ate(data, **COMMON).first()
    many = engine.do_ate(three, cluster="unit", **COMMON).first()
    assert many.std_error == pytest.approx(once.std_error, rel=0.1)


def test_rows(engine, data):
    for learner in ("dr_learner", "t_learner", "s_learner", "x_learner"):
        rows = engine.do_cate(data, id="id", estimator=learner, **COMMON).toPandas()
        assert len(rows) == N and sorted(rows.row_id) == list(range(N)) and abs(rows.cate.mean() - 3) < 0.2
    assert engine.do_uplift(data, **COMMON).count() == 20
    assert engine.do_policy_value(data, **COMMON).first().value_treat_all == pytest.approx(3, abs=0.2)
    assert {r.action for r in engine.do_optimal_policy(data, **COMMON).collect()} == {"treat"}


def test_other_treatments(engine, data):
    assert engine.do_ape(data, treatment="dose", outcome="y_dose", covariates=["x1"]).first().estimate == pytest.approx(2, abs=0.1)
    curve = engine.do_dose_response(data, treatment="dose", outcome="y_dose", covariates=["x1"], grid=5).toPandas()
    assert len(curve) == 5 and ((curve.mu.diff() / curve.dose.diff()).dropna() - 2).abs().max() < 0.3
    levels = {r.level: r for r in engine.do_ate_levels(data, treatment="arm", outcome="y_arm", covariates=["x1"]).collect()}
    assert levels["B"].estimate == pytest.approx(1.5, abs=0.3) and levels["C"].estimate == pytest.approx(-1, abs=0.3)
    iv = engine.do_iv(data, treatment="d", outcome="y_iv", instrument="z", covariates=["x1"]).first()
    assert iv.estimate == pytest.approx(2, abs=0.2) and not iv.weak_instrument
    parts = {r.estimand: r.estimate for r in engine.do_mediate(data, treatment="t", outcome="y_med", mediator="med", covariates=["x1"]).collect()}
    assert parts["natural_direct"] == pytest.approx(1.5, abs=0.15) and parts["natural_indirect"] == pytest.approx(1.6, abs=0.15)


def test_diagnostics(engine, data):
    assert engine.do_balance(data, **COMMON).filter("abs(smd_weighted) < 0.1").count() == 3
    assert engine.do_overlap(data, **COMMON).count() == 10
    assert engine.do_refute(data, method="placebo_treatment", **COMMON).first().passed
    assert engine.do_sensitivity(data, **COMMON).first().robustness_value > 0.3


def test_graphs(engine):
    dot = 'digraph { u [latent]; x -> t; x -> y; u -> t; u -> y; t -> m; m -> y; "z" -> t; }'
    engine.do_graph_create("Sales", dot)
    assert [r.name for r in engine.do_graphs().collect()] == ["sales"]
    found = {r.strategy: r for r in engine.do_identify("sales", "t", "y").collect()}
    assert not found["backdoor"].identifiable and found["frontdoor"].adjustment_set == ["m"] and found["iv"].adjustment_set == ["z"]
    with pytest.raises(CausalError):
        engine.do_graph_create("loop", "digraph { a -> b; b -> a }")
    assert engine.do_graph_drop("SALES").first().dropped and engine.do_graphs().count() == 0


def test_pool(engine, spark):
    sites = spark.createDataFrame([(1.0, 0.1, 100), (2.0, 0.2, 300), (None, 0.1, 5)], "estimate double, std_error double, n long")
    r = engine.do_ate_pool(sites).first()
    assert r.estimate == pytest.approx(1.75) and r.std_error == pytest.approx(0.152069063257456) and r.n_sites == 2
    assert r.q == pytest.approx(20) and r.q_p_value == pytest.approx(7.7442164310441e-06) and r.i_squared == pytest.approx(0.95)


def test_refusals(engine, data, spark):
    for bad in ({"treatment": "x1"}, {"treatment": "t", "outcome": "region"}, {"treatment": "t", "outcome": "nope"}, {"treatment": "t", "outcome": "y", "trim": 0.7}, {"treatment": "t", "outcome": "y", "estimator": "magic"}):
        with pytest.raises(CausalError):
            engine.do_ate(data, **bad)
    with pytest.raises(CausalError, match="8"):
        engine.do_ate(data.limit(5), **COMMON)
    with pytest.raises(CausalError, match="no files|source|model"):
        engine.do_ate(data, model="causalpfn", **COMMON)


def test_nulls(engine, spark):
    rows = [(i % 2, float(i % 7) if i % 5 else None, [None, "a", "b"][i % 3], float(i % 2 * 2 + (i % 11)) if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "t int, x double, colour string, y double")
    summary = engine.do_frame_summary(df, treatment="t", outcome="y").toPandas()
    assert {"x", "x__missing", "colour=b", "colour__missing"} <= set(summary.feature)
    assert engine.do_ate(df, treatment="t", outcome="y").first().n == sum(r[3] is not None for r in rows)
