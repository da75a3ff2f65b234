"""Folds and draws of equal rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalith.engine import Engine
from causalith.plans.ordinals import dealt, local_folds, local_keys, numbered


def discrete(n=20_000, seed=5):
    """Binary covariate, treatment and outcome, with an effect of 0.2."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, n)
    t = (rng.random(n) < 0.3 + 0.4 * x).astype(int)
    y = (rng.random(n) < 0.2 + 0.3 * x + 0.2 * t).astype(int)
    return pd.DataFrame({"x": x, "t": t, "y": y})


@pytest.fixture(scope="module")
def binary(spark):
    return spark.createDataFrame(discrete()).repartition(6).persist()


@pytest.mark.parametrize("estimator", ["aipw", "dml", "ipw", "regression"])
def test_discrete_rows(spark, binary, estimator):
    r = Engine(spark).do_ate(binary, treatment="t", outcome="y", covariates=["x"], estimator=estimator, bootstrap_reps=40).first()
    assert abs(r["estimate"] - 0.2) < 0.02
    # Eight distinct rows: the bootstrap's error is that of the same model by its formula.
    pdf = discrete()
    v = sum((pdf.x == k).mean() ** 2 * sum(pdf[(pdf.x == k) & (pdf.t == a)].y.var() / ((pdf.x == k) & (pdf.t == a)).sum() for a in (0, 1)) for k in (0, 1))
    assert abs(r["std_error"] / v**0.5 - 1) < (0.3 if estimator == "regression" else 0.15)


def test_partitions_do_not_matter(spark, binary):
    runs = [Engine(spark).do_ate(df, treatment="t", outcome="y", covariates=["x"], estimator="aipw").first()["estimate"] for df in (binary, binary.coalesce(1), binary.repartition(3, "y"))]
    assert max(runs) - min(runs) < 1e-12


def test_numbers(spark):
    df = spark.createDataFrame([(k, k % 7) for k in range(500)], "i long, _key long").repartition(5).persist()
    keys = [r["_key"] for r in numbered(df).collect()]
    assert len(set(keys)) == 500
    again = {r["_key"] for r in numbered(df.repartition(2).persist()).collect()}
    assert again == set(keys)
    alone = spark.range(50).select(F.col("id").alias("_key"))
    assert {r[0] for r in numbered(alone).collect()} == {r[0] for r in alone.select(F.xxhash64("_key", F.lit(0).cast("long"))).collect()}
    assert numbered(alone.limit(0)).count() == 0


def test_folds_are_even_in_each_arm(spark):
    df = spark.range(10_000).select(F.xxhash64("id").alias("_key"), (F.col("id") % 10 == 0).cast("double").alias("_t"))
    sizes = {(r["_t"], r["_fold"]): r["count"] for r in dealt(df, 5, 42, "_t").groupBy("_t", "_fold").count().collect()}
    assert len(sizes) == 10
    assert all(abs(n - (200 if t else 1800)) <= 8 for (t, _), n in sizes.items())
    key = local_keys(np.zeros(100, np.int64), False)
    assert len(set(key.tolist())) == 100
    arm = np.array([0.0] * 60 + [1.0] * 40)
    fold = local_folds(key, arm, 5, 42, False)
    assert all((fold[arm == a] == f).sum() == (12 if a == 0 else 8) for a in (0, 1) for f in range(5))
