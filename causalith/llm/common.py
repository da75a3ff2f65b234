"""Helpers that the corpus operators share: tables, shared folders, Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="causalith-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    Unlike a cached frame the copy outlives lost executors, and unlike ``checkpoint`` later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one as a path of the file system, for files that workers map into memory."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    elif "://" in base:
        raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a mounted file system, not {base}")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def utf8(column) -> F.Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the offsets of its values; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_large_binary(array.type) else "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


#: SplitMix64's fixed constants.
_GAMMA, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64's finalizer over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * int(_GAMMA) + int(_GAMMA)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


#: The white space of words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts.

    Returns the hash of each word, the text it lies in, and its first and past-the-last byte in ``data``. Words end at
    the end of a text. The hash is a polynomial over the bytes modulo 2**64, finished by a mixer, so equal words have
    equal hashes anywhere.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
    ends = np.flatnonzero(last) + 1
    lengths = ends - starts
    low = LOWER[data] if lower else data
    # Words of up to 8 bytes are their own bytes; longer ones fold in 8 bytes at a time.
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    h = mix64(lengths.astype(np.uint64), 1)
    todo, at = np.arange(len(starts)), 0
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    while len(todo):
        left = np.minimum(lengths[todo] - at, 8)
        piece = np.ascontiguousarray(windows[starts[todo] + at]).view("<u8").ravel() & masks[left]
        h[todo] = mix64(h[todo] ^ piece, 2)
        at += 8
        todo = todo[lengths[todo] > at]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return h, doc, starts, ends


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers stay for other tasks and their neighbours."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def slices(batches, column: str, limit: int = 1 << 20):
    """Arrow batches cut so that a text column has about ``limit`` bytes in each; a longer text stands alone.

    When all are used, the memory that they took is released.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        del batch
    release()
