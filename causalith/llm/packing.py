"""Bounded-space online packing of documents into training sequences.

Each partition streams its documents past a fixed number of open windows. A document's full windows go out at once; its
rest goes to the open window that it fits best. Where none fits and all windows are open, the fullest is topped up
with a cut of the rest and emitted full. At the end a partition merges what its windows hold, and the one window that
stays short in each partition is merged with those of its neighbours. Memory is the open windows, whatever the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .tokens import WordTokenizer, tokenizer_path

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
#: Partitions whose last windows are merged in one task.
_NEIGHBOURS = 32


class Windows:
    """The open windows of one partition; pieces are (document, start, ids, tokens of the document)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count = capacity, most, 0
        self.free: list[tuple[int, int]] = []  # free places and window, in order
        self.held: dict[int, list] = {}

    def add(self, doc, ids: np.ndarray):
        """Yields the windows that the document fills."""
        at, total = 0, len(ids)
        while total - at >= self.capacity:
            yield [(doc, at, ids[at : at + self.capacity], total)]
            at += self.capacity
        while at < total:
            rest = total - at
            i = bisect_left(self.free, (rest, -1))
            if i < len(self.free):
                free, w = self.free.pop(i)
                take = rest
            elif len(self.free) < self.most:
                free, w = self.capacity, self.count
                self.count += 1
                self.held[w] = []
                take = rest
            else:
                free, w = self.free.pop(0)
                take = free
            self.held[w].append((doc, at, ids[at : at + take], total))
            at += take
            if free == take:
                yield self.held.pop(w)
            else:
                insort(self.free, (free - take, w))

    def merge(self):
        """Yields what the open windows hold, poured together; all but the last are full."""
        yield from poured((p for _, w in self.free for p in self.held[w]), self.capacity)


def poured(pieces, capacity: int):
    """Windows of pieces in order, cut where a window is full."""
    window, fill = [], 0
    for doc, at, ids, total in pieces:
        while len(ids):
            take = min(len(ids), capacity - fill)
            window.append((doc, at, ids[:take], total))
            fill += take
            at += take
            ids = ids[take:]
            if fill == capacity:
                yield window
                window, fill = [], 0
    if window:
        yield window


def _rows(window, sequence: int, keep_ids: bool, open_: bool) -> list[tuple]:
    rows, offset = [], 0
    for doc, at, ids, total in window:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        rows.append((doc, at, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep_ids or open_ else None, open_))
        offset += len(ids)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, capacity: int = 2048, open_windows: int = 64, end_id: int = 1, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) in sequences of at most ``capacity`` ids.

    One row per piece; ``ids`` holds its ids as little-endian unsigned 32-bit values unless ``keep_ids`` is false. A null
    or empty text is the end id alone. Equal rows are packed each for itself, a null doc_id stays null, other columns
    are left aside, no rows give no rows. Only the last window of each ``_NEIGHBOURS`` partitions needs padding.
    """
    path = path or tokenizer_path()

    def stream(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        tokenizer, windows, rows = WordTokenizer(path), Windows(capacity, open_windows), []
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = tokenizer.encode(batch.column("text"), end_id)
            bounds = offsets.tolist()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                for window in windows.add(doc, ids[a:b]):
                    rows += _rows(window, sequence, keep_ids, False)
                    sequence += 1
            for w in windows.held:  # a view would keep the whole batch's ids
                windows.held[w] = [(d, s, x.copy() if x.base is not None else x, n) for d, s, x, n in windows.held[w]]
            if rows:
                yield _batch(rows)
                rows = []
        for window in windows.merge():
            rows += _rows(window, sequence, keep_ids, sum(len(p[2]) for p in window) < capacity)
            sequence += 1
        if rows:
            yield _batch(rows)

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pydict()
        pieces = [(d, s, np.frombuffer(x, "<u4"), n) for d, s, x, n in zip(*(group[c] for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        first = (1 << 62) + ((min(group["sequence_id"]) >> 32) // _NEIGHBOURS << 32)
        rows = [r for i, w in enumerate(poured(pieces, capacity)) for r in _rows(w, first + i, keep_ids, False)]
        return pa.Table.from_batches([_batch(rows)])

    packed = materialize(docs.select("doc_id", "text").mapInArrow(stream, _SCHEMA), "packed")
    short = packed.filter("open").groupBy(F.expr(f"shiftright(sequence_id, 32) div {_NEIGHBOURS}")).applyInArrow(join, _SCHEMA)
    out = packed.filter("not open").unionByName(short).drop("open")
    return out if keep_ids else out.drop("ids")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
