"""Components of paths, stars and random graphs, and how many rounds they take."""

import numpy as np

from causalith.llm import components as module
from causalith.llm.components import components


def rounds(monkeypatch):
    seen, make = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: (seen.append(name), make(df, name))[1])
    return seen


def test_long_path(spark, monkeypatch):
    seen = rounds(monkeypatch)
    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long")
    got = components(edges).collect()
    assert len(got) == 2001 and {r["label"] for r in got} == {0}
    assert seen.count("least") < 20


def test_shapes(spark):
    rng = np.random.default_rng(1)
    star = [(50_000, 50_000 + int(k)) for k in rng.permutation(200) - 100]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (140, 2))]
    edges = [*star, *pairs, (7, 7), (None, 3), (9, None), (999_999, 999_999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
