"""Rows of a frame and what is computed over them: sums of arrays, derived columns, sums by cluster.

``SparkRows`` has them in a DataFrame: functions see blocks of columns as numpy arrays inside the tasks, and only their sums
come to the driver. ``LocalRows`` has the same interface over arrays, for a task that holds a bounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partial sums that come to the driver at once; beyond that they are first added up in tasks.
_PARTIALS = 256


class _Block(dict):
    """Columns of a batch as arrays, each made when it is first asked for; ``X`` has the features side by side."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        super().__init__()
        self.batch, self.width = batch, width

    def __missing__(self, name: str) -> np.ndarray:
        if name == "X":
            v = np.stack([self[f"x{j}"] for j in range(self.width)], 1) if self.width else np.zeros((self.batch.num_rows, 0))
        else:
            col = self.batch.column(name)
            if pa.types.is_floating(col.type) or pa.types.is_integer(col.type):
                v = col.to_numpy(zero_copy_only=False)
            elif pa.types.is_boolean(col.type):
                v = col.cast(pa.int8()).to_numpy(zero_copy_only=False).astype(float)
            else:
                v = np.array(col.to_pylist(), dtype=object)
        self[name] = v
        return v


def _columns(batch: pa.RecordBatch, width: int, steps: tuple = ()) -> _Block:
    """The block of a batch, with what ``steps`` add to it or put in place of its columns."""
    block = _Block(batch, width)
    for f, names in steps:
        new = [np.asarray(v, float) for v in f(block)]
        block.update(zip(names, new, strict=True))
        if any(n == f"x{j}" for n in names for j in range(width)):
            block.pop("X", None)
    return block


class SparkRows:
    """Rows of a frame; derived columns that are not yet kept are computed in the task that uses them, without a worker of their own."""

    def __init__(self, df: DataFrame, width: int, steps: tuple = ()):
        self._df, self.width, self._steps = df, width, steps

    @property
    def df(self) -> DataFrame:
        if self._steps:
            width, steps = self.width, self._steps
            names = list(dict.fromkeys(n for _, some in steps for n in some))
            kept = [c for c in self._df.columns if c not in names]

            def add(batches):
                for batch in batches:
                    block = _columns(batch, width, steps) if batch.num_rows else dict.fromkeys(names, np.zeros(0))
                    batch = batch.select(kept)
                    for name in names:
                        batch = batch.append_column(name, pa.array(block[name]))
                    yield batch

            schema = T.StructType([*(self._df.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])
            self._df, self._steps = self._df.mapInArrow(add, schema), ()
        return self._df

    def sum(self, f) -> dict[str, np.ndarray]:
        """The sum of the arrays that ``f`` gives for each block, by name."""
        width, steps, df = self.width, self._steps, self._df

        def partial(batches):
            from pyspark import TaskContext

            total: dict[str, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    for k, v in f(_columns(batch, width, steps)).items():
                        total[k] = total[k] + v if k in total else np.asarray(v, float)
            if total:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(total), pa.int32()), pa.array(list(total)), pa.array([list(v.shape) for v in total.values()], pa.list_(pa.int32())), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))],
                    ["part", "name", "shape", "values"],
                )

        sums = df.mapInArrow(partial, "part int, name string, shape array<int>, values array<double>")
        if df.rdd.getNumPartitions() > _PARTIALS:
            sums = sums.groupBy("name", "shape", F.expr(f"part div {_PARTIALS}").alias("g")).applyInArrow(_added, "part int, name string, shape array<int>, values array<double>")
        out: dict[str, np.ndarray] = {}
        for r in sorted(sums.collect(), key=lambda r: r["part"]):
            v = np.array(r["values"]).reshape(r["shape"])
            out[r["name"]] = out[r["name"]] + v if r["name"] in out else v
        return out

    def append(self, f, names: list[str]) -> SparkRows:
        """With further columns of numbers (in place of any of their names), which ``f`` gives in a list for each block."""
        return SparkRows(self._df, self.width, (*self._steps, (f, names)))

    def filter(self, condition, _local=None) -> SparkRows:
        return SparkRows(self.df.filter(condition), self.width)

    def keep(self) -> SparkRows:
        """The rows are read several times from here on."""
        self._df = self.df.persist()
        return self

    def cluster_gram(self, f, width: int) -> tuple[np.ndarray, int]:
        """Sum over clusters of s s', s being the sum of the rows ``f`` gives in a cluster, and the number of clusters."""
        names = [f"_s{j}" for j in range(width)]
        scored = self.append(lambda c: list(f(c).T), names).df
        sums = scored.groupBy("_cluster").agg(*(F.sum(n).alias(n) for n in names))
        s = SparkRows(sums, 0).sum(lambda c: {"g": (m := np.stack([c[n] for n in names], 1)).T @ m, "n": np.array([len(m)], float)})
        return s["g"], int(s["n"][0])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    total = np.sum([np.asarray(v) for v in rows.column("values").to_pylist()], axis=0)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "name": pa.array([key[0].as_py()]), "shape": pa.array([rows.column("shape")[0].as_py()], pa.list_(pa.int32())), "values": pa.array([total], pa.list_(pa.float64()))})


class LocalRows:
    def __init__(self, columns: dict[str, np.ndarray], width: int):
        self.columns, self.width = columns, width
        columns["X"] = np.stack([columns[f"x{j}"] for j in range(width)], 1) if width else np.zeros((len(next(iter(columns.values()))), 0))

    def sum(self, f) -> dict[str, np.ndarray]:
        return {k: np.asarray(v, float) for k, v in f(self.columns).items()}

    def append(self, f, names: list[str]) -> LocalRows:
        return LocalRows(self.columns | {n: np.asarray(v, float) for n, v in zip(names, f(self.columns), strict=True)}, self.width)

    def filter(self, _condition, local) -> LocalRows:
        keep = local(self.columns)
        return LocalRows({k: v[keep] for k, v in self.columns.items() if k != "X"}, self.width)

    def keep(self) -> LocalRows:
        return self

    def cluster_gram(self, f, width: int) -> tuple[np.ndarray, int]:
        s = f(self.columns)
        _, g = np.unique(self.columns["_cluster"].astype(str), return_inverse=True)
        sums = np.zeros((g.max() + 1, width))
        np.add.at(sums, g, s)
        return sums.T @ sums, len(sums)
