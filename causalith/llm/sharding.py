"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Entry (p, t) of the matrix is how many rows source partition p sends to target block t. For a uniform random
permutation of all rows the matrix follows a multivariate hypergeometric law whose row sums are the partitions' sizes
and whose column sums are the blocks' sizes. No task needs the whole matrix: the source partitions are the leaves of a
binary tree, and each task walks from the root to its own leaf, splitting the column sums at every node by draws whose
generator is seeded by the node. All tasks draw the same numbers at a node, so the leaves agree without messages.

Then a partition deals its own rows to the blocks in random order (permute locally), Spark exchanges the rows by
block, and each block orders its rows at random (permute again). Blocks are bounded parts of shards, so neither a
shard nor a hot key ever meets in one task.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: numpy draws hypergeometric variates up to this population.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are good; any population size.

    Beyond numpy's limit this is rejection by a ratio of uniforms around the mode, with log-gamma probabilities.
    """
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    total = good + bad
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)

    def weight(k: int) -> float:
        return -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(draws - k + 1) + lgamma(bad - draws + k + 1))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    peak = weight(mode)
    var = draws * good / total * bad / total * (total - draws) / max(1, total - 1)
    center, width = mode + 0.5, sqrt(8 / np.e) * sqrt(var + 0.5) + 3 - 2 * sqrt(3 / np.e)
    while True:
        u, v = rng.random(), rng.random()
        k = int(np.floor(center + width * (v - 0.5) / max(u, 1e-300)))
        if low <= k <= high and 2 * np.log(max(u, 1e-300)) <= weight(k) - peak:
            return k


def split(rng: np.random.Generator, columns: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of ``draws`` rows fall to each column."""
    out, left, rest = np.zeros_like(columns), int(columns.sum()), draws
    for i, c in enumerate(columns.tolist()):
        if rest == 0:
            break
        out[i] = hypergeometric(rng, c, left - c, rest)
        rest -= int(out[i])
        left -= c
    return out


def matrix_row(counts: np.ndarray, columns: np.ndarray, row: int, seed: int) -> np.ndarray:
    """Row ``row`` of the communication matrix with row sums ``counts`` and column sums ``columns``."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    low, high, node = 0, len(counts), 1
    columns = np.asarray(columns, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, node]), columns, int(ends[mid] - ends[low]))
        if row < mid:
            columns, high, node = left, mid, 2 * node
        else:
            columns, low, node = columns - left, mid, 2 * node + 1
    return columns


def block_sizes(n: int, shards: int, blocks: int) -> np.ndarray:
    """Sizes of all blocks, shard by shard: shards differ by one row at most, and so do a shard's blocks."""
    shard = [n // shards + (s < n % shards) for s in range(shards)]
    return np.array([m // blocks + (b < m % blocks) for m in shard for b in range(blocks)], np.int64)


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 42, block_rows: int = 1 << 20) -> DataFrame:
    """Add ``shard`` and ``slot``: a uniform random shuffle whose shards differ by one row at most.

    Slots run from 0 without gaps in each shard. Columns of those names are replaced. Rows may hold nulls, repeat, or
    be absent (an empty frame stays empty); nothing but their number counts. Reproducible for the same input partitions.
    """
    kept = df.drop("shard", "slot")
    # The partitions must be the same in both passes and after a lost executor.
    kept = kept.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else _checkpointed(kept)
    pids = {r[0]: r[1] for r in kept.groupBy(F.spark_partition_id()).count().collect()}
    counts = np.zeros(kept.rdd.getNumPartitions(), np.int64)
    for k, v in pids.items():
        counts[k] = v
    n = int(counts.sum())
    blocks = max(4, ceil(n / shards / block_rows))
    sizes = block_sizes(n, shards, blocks)
    schema = T.StructType([*kept.schema.fields, T.StructField("_block", T.IntegerType()), T.StructField("_key", T.LongType())])

    def deal(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, 0, pid])
        labels = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, pid, seed)))
        at = 0
        for batch in batches:
            m = batch.num_rows
            batch = batch.append_column("_block", _pa(labels[at : at + m]))
            yield batch.append_column("_key", _pa(rng.integers(-(1 << 63), (1 << 63) - 1, m, np.int64)))
            at += m

    dealt = kept.mapInArrow(deal, schema)
    order = Window.partitionBy("_block").orderBy("_key")
    shard = F.expr(f"_block div {blocks}")
    inside = F.expr(f"_block % {blocks}")
    size = F.lit(n // shards) + (shard < n % shards).cast("long")
    start = inside * F.expr("_size div " + str(blocks)) + F.least(inside, F.col("_size") % blocks)
    return (
        dealt.withColumn("_size", size)
        .withColumn("slot", (start + F.row_number().over(order) - 1).cast("long"))
        .withColumn("shard", shard.cast("int"))
        .drop("_block", "_key", "_size")
    )


def _checkpointed(df: DataFrame) -> DataFrame:
    from .common import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint()


def _pa(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt to 8 shards by the law ``rows``; null texts have size 1 and CRC 0."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
