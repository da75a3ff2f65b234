"""Benchmark decontamination by rare seeds and local alignment.

Test items become word sequences (ASCII letters lowered, ASCII punctuation as blanks), and every run of ``SEED`` words is a
seed. One pass over the documents finds all seeds by hash, counts the documents that each occurs in, and keeps the places
where several seeds of one item lie near one diagonal, as an edited copy's would. Seeds are rare if they are in no more
than four times as many documents as the median of their item's seeds that occur at all: function words are not, but
those of an item that leaked often still are. Places with enough rare seeds are aligned with the item by Smith-Waterman
over words. So are the others (a passage may be common where the rest of its item is not), unless they share too few
words with the item for any alignment to reach the score.

Test items come to the tasks in blocks of a fixed number of seeds, one block after the other, so their table may be of
any size; documents are never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, ragged, slices, table, text_buffer, word_hashes

SEED, BLOCK_SEEDS = 3, 1_000_000
#: An item with fewer seeds needs only one at a place, others two.
FEW = 4
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum() and c > 32 and c != 39]] = 32


def words(data: np.ndarray, offsets: np.ndarray):
    return word_hashes(_PLAIN[data], offsets)


def seeds(h: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``SEED`` words; a shorter sequence is one seed as a whole."""
    ends = np.cumsum(count)
    starts = ends - count
    n = np.where(count >= SEED, count - SEED + 1, (count > 0).astype(np.int64))
    first = ragged(starts, n)
    owner = np.repeat(np.arange(len(count)), n)
    key = mix64(np.minimum(count, SEED)[owner].astype(np.uint64), 21)
    for k in range(SEED):
        inside = first + k < ends[owner]
        if len(h):
            key = np.where(inside, mix64(key ^ h[np.minimum(first + k, len(h) - 1)], 22), key)
    return key, first


class Items:
    """A block of test items: their words, and an index of their seeds."""

    def __init__(self, ids: list, texts: list):
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        self.ids = np.array(ids, np.int64)
        self.words, doc, _, _ = words(data, offsets)
        self.count = np.bincount(doc, minlength=len(ids))
        self.start = np.cumsum(self.count) - self.count
        key, first = seeds(self.words, doc, self.count)
        item = np.repeat(np.arange(len(ids)), np.where(self.count >= SEED, self.count - SEED + 1, (self.count > 0).astype(np.int64)))
        self.keys, back = np.unique(key, return_inverse=True)
        order = np.argsort(back, kind="stable")
        #: Of each seed, in the order of the keys: the items it is in, and its first word there.
        self.item, self.place, self.seed = item[order], (first - self.start[item])[order], back[order]
        self.begin = np.searchsorted(self.seed, np.arange(len(self.keys) + 1))
        self.need = np.where(np.bincount(self.item, minlength=len(ids)) < FEW, 1, 2)
        # Most seeds of documents are in no item: a bit for each value of a part of the hash tells them.
        self.bits = max(16, min(26, int(len(self.keys)).bit_length() + 6))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``key`` that are seeds, and which."""
        at = np.flatnonzero(self.maybe[(key >> np.uint64(64 - self.bits)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.keys, key[at]), max(0, len(self.keys) - 1))
        hit = self.keys[which] == key[at] if len(at) else np.zeros(0, bool)
        return at[hit], which[hit]

    def rare(self, frequency: np.ndarray) -> np.ndarray:
        """Whether each entry of the index is rare for its item, from the seeds' document counts; seeds in no document do not count."""
        f = frequency[self.seed]
        order = np.lexsort((f, self.item))
        ends = np.cumsum(np.bincount(self.item, minlength=len(self.ids)))
        n = np.bincount(self.item[f > 0], minlength=len(self.ids))
        median = np.zeros(len(self.ids))
        some = n > 0
        median[some] = f[order][(ends - n + (n - 1) // 2)[some]]
        return f <= 4 * median[self.item]


def places(items: Items, data: np.ndarray, offsets: np.ndarray):
    """Candidate places and seed counts of some texts.

    Of each place: text, item, entries of the index that it holds, and first and past-the-last byte of its surroundings.
    """
    h, doc, starts, ends = words(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    key, first = seeds(h, doc, count)
    at, which = items.find(key)
    text = doc[first[at]] if len(h) else at
    pair = np.unique(np.stack([which, text], 1), axis=0)
    seed, documents = np.unique(pair[:, 0], return_counts=True)
    n = items.begin[which + 1] - items.begin[which]
    entry = ragged(items.begin[which], n)
    text, word = np.repeat(text, n), np.repeat(first[at], n)
    item = items.item[entry]
    diagonal = word - items.place[entry]
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal, entry = text[order], item[order], diagonal[order], entry[order]
    slack = np.maximum(8, items.count[item] // 4)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    place = np.cumsum(new) - 1
    distinct = np.bincount(np.unique(np.stack([place, entry], 1), axis=0)[:, 0]) if len(place) else np.zeros(0, np.int64)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) if len(begin) else begin
    out = []
    last_word = np.cumsum(count)
    for p in np.flatnonzero(distinct >= items.need[item[begin]]).tolist() if len(begin) else []:
        a, b = int(begin[p]), int(end[p])
        t, i, s = int(text[a]), int(item[a]), int(slack[a])
        low = max(int(diagonal[a]) - s, int(last_word[t] - count[t]))
        high = min(int(diagonal[b - 1]) + int(items.count[i]) + s, int(last_word[t]))
        out.append((t, i, np.unique(entry[a:b]).tolist(), int(starts[low]), int(ends[high - 1])))
    return out, seed, documents


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words for pairs of sequences: best score, and how far into each sequence it ends.

    A match is 1, a replaced, added or left out word -1. All pairs advance together, one word of ``a`` per step.
    """
    n, rows, columns = len(a), max(map(len, a), default=0), max(map(len, b), default=0)
    left = np.zeros((n, rows), np.uint64)
    right = np.ones((n, columns), np.uint64)
    inside = np.zeros((n, rows), bool)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left[k, : len(x)], inside[k, : len(x)], right[k, : len(y)] = x, True, y
        right[k, len(y) :] = 1
    score = np.zeros((n, columns + 1), np.int32)
    best, row, column = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = np.arange(columns + 1, dtype=np.int32)
    for r in range(rows):
        match = np.where(right == left[:, r : r + 1], 1, -1).astype(np.int32)
        new = np.zeros_like(score)
        new[:, 1:] = np.maximum(score[:, :-1] + match, score[:, 1:] - 1)
        np.maximum(new, 0, out=new)
        # Left out words: the best of all cells to the left, less their distance.
        new = np.maximum.accumulate(new + step, axis=1) - step
        new[~inside[:, r]] = 0
        score = new
        top = score.max(1)
        better = top > best
        best = np.where(better, top, best)
        row = np.where(better, r + 1, row)
        column = np.where(better, score.argmax(1), column)
    return best, row, column


def batched(a: list[np.ndarray], b: list[np.ndarray], cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``align`` on pairs of like length together, about ``cells`` words at once."""
    best, row, column = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    order, at = np.argsort(size, kind="stable")[::-1], 0
    while at < len(order):
        some = order[at : at + max(1, cells // max(1, int(size[order[at]])))]
        best[some], row[some], column[some] = align([a[k] for k in some], [b[k] for k in some])
        at += len(some)
    return best, row, column


_ROW = "doc_id long, item int, entries array<int>, first long, text string, seed int, documents long"


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, enough: int = 13) -> DataFrame:
    """Passages of test items in documents: ``doc_id``, ``item_id``, ``score``, ``first_byte``, ``last_byte``.

    One row for each document and item whose best alignment scores at least ``share`` of the item's words, or ``enough``; the
    score is given as a share of the item's words, and the bytes are those of the aligned passage (past the last).
    Null texts and items without words match nothing; equal rows of a document give one row, as do equal alignments
    (the first one). Rows without doc_id or item_id are left aside.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, first_byte long, last_byte long")
    ids, texts, size = [], [], 0
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").toLocalIterator()
    for r in rows:
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 2
        if size > BLOCK_SEEDS:
            out = out.unionByName(_block(docs, Items(ids, texts), share, enough))
            ids, texts, size = [], [], 0
    if ids:
        out = out.unionByName(_block(docs, Items(ids, texts), share, enough))
    first = F.min(F.struct((-F.col("score")).alias("s"), "first_byte", "last_byte")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", (-F.col("m.s")).alias("score"), "m.first_byte", "m.last_byte")


def _block(docs: DataFrame, items: Items, share: float, enough: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches):
        items = shared.value
        tally = np.zeros(len(items.keys), np.int64)
        names = [x.split()[0] for x in _ROW.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        batch_of = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        for batch in slices(batches, "text", 2 << 20):
            data, offsets = text_buffer(batch.column("text"))
            found, seed, documents = places(items, data, offsets)
            tally[seed] += documents
            if found:
                doc = batch.column("doc_id")
                rows = [(doc[t].as_py(), i, e, a - int(offsets[t]), data[a:b].tobytes().decode(), None, None) for t, i, e, a, b in found]
                yield batch_of(zip(*rows, strict=True))
        seen = np.flatnonzero(tally)
        if len(seen):
            none = [None] * len(seen)
            yield batch_of([none, none, none, none, none, seen, tally[seen]])

    scanned = materialize(docs.mapInArrow(scan, _ROW), "seed-places")
    frequency = np.zeros(len(items.keys), np.int64)
    for r in scanned.filter("seed is not null").groupBy("seed").agg(F.sum("documents")).toLocalIterator():
        frequency[r[0]] = r[1]
    rare = docs.sparkSession.sparkContext.broadcast(items.rare(frequency))

    def check(batches):
        items, is_rare = shared.value, rare.value
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            data, offsets = text_buffer(pa.array([r["text"] for r in rows], pa.large_string()))
            h, doc, starts, ends = words(data, offsets)
            bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
            item = np.array([r["item"] for r in rows])
            a = [items.words[items.start[i] : items.start[i] + items.count[i]] for i in item]
            b = [h[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
            n = items.count[item]
            least = np.minimum(share * n, enough)
            # A score is at most the number of words that can match.
            can = np.array([is_rare[r["entries"]].sum() >= items.need[r["item"]] or np.isin(y, x).sum() >= low for r, x, y, low in zip(rows, a, b, least, strict=True)])
            at = np.flatnonzero(can)
            best, row, column = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            best[at], row[at], column[at] = batched([a[k] for k in at], [b[k] for k in at])
            keep = np.flatnonzero(can & (best >= least))
            # The same alignment from its end gives its beginning.
            back = np.zeros(len(rows), np.int64)
            _, _, back[keep] = batched([a[k][: row[k]][::-1] for k in keep], [b[k][: column[k]][::-1] for k in keep])
            base = np.array([r["first"] for r in rows], np.int64) - offsets[:-1]
            first = starts[(bounds[:-1] + column - np.maximum(back, 1))[keep]] + base[keep]
            last = ends[(bounds[:-1] + column - 1)[keep]] + base[keep]
            cols = [pa.array([rows[k]["doc_id"] for k in keep.tolist()], pa.int64()), pa.array(items.ids[item[keep]]), pa.array(best[keep] / n[keep]), pa.array(first), pa.array(last)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "first_byte", "last_byte"])

    return scanned.filter("seed is null").mapInArrow(check, "doc_id long, item_id long, score double, first_byte long, last_byte long")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
