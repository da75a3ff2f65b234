"""What a task holds does not grow with its rows, and shared steps give exact results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalith.functions.draws import poisson, uniform
from causalith.plans.frame import order_statistics
from causalith.plans.ordinals import numbered
from causalith.plans.rows import SparkRows


def test_numbering_remembers_one_key(spark, monkeypatch):
    """Runs of a key go on over batches, and no task keeps a table of the keys that it has seen."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 400, 1, 3).select((F.col("id") % 5).alias("_key")).persist()
        assert len({r["_key"] for r in numbered(df).collect()}) == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = numbered(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_key" in plan.split("MapInArrow")[-1]


def test_derived_columns_share_a_worker(spark):
    rows = SparkRows(spark.range(100).select(F.col("id").cast("double").alias("x0")), 1)
    more = rows.append(lambda c: [c["X"][:, 0] * 2], ["a"]).append(lambda c: [c["a"] + 1, c["x0"] + 1], ["b", "x0"])
    s = more.append(lambda c: [c["X"][:, 0]], ["z"]).sum(lambda c: {"s": np.array([c["a"].sum(), c["b"].sum(), c["x0"].sum(), c["z"].sum()])})["s"]
    assert s.tolist() == [9900, 10000, 5050, 5050]
    assert more.df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(more.df.columns) == ["a", "b", "x0"] and more.df.agg(F.sum("x0")).first()[0] == 5050


@pytest.mark.parametrize("values", [[3.0, 1.0, None, 1.0, 2.0, 9.0, -4.0], [5.0] * 50 + [1.0] * 30, list(map(float, range(300)))])
def test_order_statistics(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    want = sorted(v for v in values if v is not None)
    places = [0, len(want) // 3, len(want) - 1, len(want) // 3]
    assert order_statistics(df, F.col("v"), places) == [want[k] for k in places]


def test_fast_counts_are_the_exact_ones():
    key = np.random.default_rng(1).integers(-(2**62), 2**62, 200_000)
    assert (poisson(key, 3, 4) == np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])), uniform(key, 3, 4), side="right")).all()


def test_large_groups_read_their_own_rows(spark):
    """Groups across tasks have the results of the same rows alone, null is a group, and each reads its own files only."""
    from causalith.config import Config
    from causalith.engine import Engine
    from causalith.operators import effects

    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], int(rng.random() < 0.5), float(rng.normal()), float(rng.normal()), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t int, y double, x double, unused long")
    engine, seen = Engine(spark, Config(group_rows=100)), []
    spec, real = {"treatment": "t", "outcome": "y", "covariates": ["x"], "estimator": "aipw"}, effects.effect
    effects.effect = lambda e, part, *a, **k: seen.append(sum("_group=" in f for f in part.inputFiles())) or real(e, part, *a, **k)
    try:
        got = {r["g"]: r for r in engine.do_ate_by(df, by="g", **spec).collect()}
    finally:
        effects.effect = real
    files = {g: engine.do_ate(df.filter(F.col("g").eqNullSafe(F.lit(g))), **spec).first() for g in ("a", "b", None)}
    assert len(seen) == 3 and all(seen)
    assert all(got[g].estimate == pytest.approx(r.estimate, abs=1e-9) and got[g].n == 200 for g, r in files.items())
