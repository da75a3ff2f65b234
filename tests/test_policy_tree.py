"""The tree of a policy: all nodes of a depth share one sort, and each gets its own deciles."""

import numpy as np
from pyspark.sql import functions as F

from causalith.engine import Engine
from causalith.operators import policy
from causalith.plans.frame import grouped_order_statistics


def test_grouped_order_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v) if v < 40 else None) for k, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 50, 3000), strict=True)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(6, F.col("v"))
    want = {k: sorted(v for q, v in rows if q == k and v is not None) for k in (0, 2)}
    places = {k: [0, len(v) // 2, len(v) - 1, len(v) // 2] for k, v in want.items()}
    assert grouped_order_statistics(df, places) == {k: [want[k][at] for at in some] for k, some in places.items()}


def test_a_depth_of_the_tree_is_one_sort(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 1200
    a, b, t = rng.random(n), rng.random(n), rng.integers(0, 2, n)
    y = t * np.where(a <= 0.5, 5.0, np.where(b <= 0.4, -9.0, 4.0)) + rng.normal(size=n) * 0.01
    df = spark.createDataFrame([(int(t[i]), float(y[i]), float(a[i]), float(b[i])) for i in range(n)], "t int, y double, a double, b double")
    calls, real = [], policy.grouped_order_statistics
    monkeypatch.setattr(policy, "grouped_order_statistics", lambda *x: calls.append(x) or real(*x))
    leaves = Engine(spark).do_optimal_policy(df, treatment="t", outcome="y", covariates=["a", "b"], depth=2).collect()
    assert len(calls) == 2 and sum(r.n for r in leaves) == n
    assert {r.action for r in leaves} == {"treat", "do not treat"}
    for r in leaves:
        m = np.ones(n, bool)
        for part in r.rule.split(" and "):
            name, sign, v = part.split()
            x = {"a": a, "b": b}[name]
            m &= (x <= float(v) + 1e-9) if sign == "<=" else (x > float(v) - 1e-9)
        assert abs(int(m.sum()) - r.n) <= 3  # the rule's numbers have four digits
