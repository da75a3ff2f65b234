"""Keys that tell equal rows apart and do not depend on partitions or the order of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import combined, uniform

#: Bins of the histogram that folds are cut from.
_BINS = 1 << 16


def numbered(df: DataFrame, key: str = "_key") -> DataFrame:
    """``df`` with ``key``, a hash of a row's content, replaced by a hash of it and the row's number among equal rows.

    Equal rows are exchangeable, so it does not matter which of them has which number. Rows are numbered inside their
    partition, sorted there so that a task remembers one key only; where a content lies in several partitions, the counts of the partitions before are added. No partition
    of a shuffle holds more than one count for each partition of ``df``. ``df`` should be persisted: it is read twice.
    """
    place = F.spark_partition_id()
    counts = df.select(F.col(key).alias("_k"), place.alias("_p")).groupBy("_k", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_before > 0 or _n > 1").select("_k", "_p", "_before").persist()
    if offsets.isEmpty():
        offsets.unpersist()
        return df.withColumn(key, F.xxhash64(key, F.lit(0).cast("long")))

    def number(batches):
        last, after = None, 0  # the key of the row before, and the number after its
        for batch in batches:
            keys = np.asarray(batch.column(key))
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
            if keys[0] == last:
                rank[: first[1] if len(first) > 1 else len(keys)] += after
            last, after = keys[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "_o"])

    made = df.withColumn("_p", place).sortWithinPartitions(key)
    made = made.mapInArrow(number, T.StructType([*made.schema.fields, T.StructField("_o", T.LongType())]))
    made = made.join(offsets.withColumnRenamed("_k", key), [key, "_p"], "left")
    return made.withColumn(key, F.xxhash64(key, F.col("_o") + F.coalesce("_before", F.lit(0)))).select(df.columns)


def dealt(df: DataFrame, folds: int, seed: int, arm: str | None) -> DataFrame:
    """``df`` with ``_fold``: rows in the order of a hash of ``_key``, cut into ``folds`` parts of one size in each arm.

    The cuts are bounds of a histogram of the hashes, so parts differ by the rows of one of its 65536 bins at most. Without
    ``arm`` (or with keys of whole clusters) a fold is the hash modulo ``folds``.
    """
    h = F.xxhash64(F.lit(seed), F.lit("fold"), "_key")
    if arm is None:
        return df.withColumn("_fold", F.pmod(h, F.lit(folds)).cast("double"))
    bin_ = F.pmod(h, F.lit(_BINS))
    rows = df.groupBy(F.col(arm).alias("a"), bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # arms times bins
    fold = F.lit(None).cast("double")
    for a in sorted({r["a"] for r in rows}):
        mine = sorted((r["b"], r["n"]) for r in rows if r["a"] == a)
        ends = np.cumsum([n for _, n in mine])
        cuts = [mine[int(np.searchsorted(ends, ends[-1] * k / folds))][0] for k in range(1, folds)]
        part = sum(((bin_ > c).cast("double") for c in cuts), F.lit(0.0))
        fold = F.when(F.col(arm) == a, part).otherwise(fold)
    return df.withColumn("_fold", fold)


def local_keys(key: np.ndarray, clustered: bool) -> np.ndarray:
    """What ``numbered`` does, for the rows of a bounded group."""
    if clustered:
        return key
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else order
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return combined(key, rank)


def local_folds(key: np.ndarray, arm: np.ndarray, folds: int, seed: int, clustered: bool) -> np.ndarray:
    """What ``dealt`` does, for the rows of a bounded group."""
    u = uniform(key, seed, 976)
    if clustered:
        return np.floor(u * folds)
    order = np.lexsort((u, arm))
    _, first, n = np.unique(arm[order], return_index=True, return_counts=True)
    out = np.empty(len(key))
    out[order] = (np.arange(len(key)) - np.repeat(first, n)) * folds // np.repeat(n, n)
    return out
