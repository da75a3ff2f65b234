"""Removal of long strings of bytes, or of words, that occur more than once in a corpus.

A window is a string of ``length`` units: bytes, or words, which are hashes then. A window's anchor is the least hash of 8
bytes or one word among its first ``reach`` places, so equal windows have their anchors at equal places. Neighbouring
windows with the same anchor form a context: the units that they cover. Equal windows lie in contexts of the same class,
which is the hash of the ``core`` units that follow the anchor; classes with one occurrence hold no repeats and go.

Equal contexts are one from here on, however many there are, and those with copies are repeats as a whole; a task does
that for the texts it holds before anything is shuffled. The rest is settled class by class in bounded tasks. Two windows of different contexts are equal if and only if they lie equally far
before their anchors, by ``p`` units, and their contexts agree in ``length - p`` units from the anchor on and in ``p`` units
before it. The suffix array of a task's contexts, read forward from the anchor and backward from it, brings those that
agree next to each other, and how far neighbours agree says of every window whether it has an equal one.

A class with too many contexts for a task is split: its windows with small ``p`` share more units after the anchor, those
with large ``p`` more units before it, so each context becomes two shorter ones with longer cores, in new classes. Contexts
that are equal then are one again. A class of single windows is one context, so this ends with every class in bounds.
Last, the repeats of each context go to all its occurrences, and each document drops the bytes they cover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, ragged, release, slices, table, text_buffer, word_hashes
from .suffix_array import suffix_array


@dataclass(frozen=True)
class Window:
    """``length`` bytes, or words as ``word_hashes`` has them."""

    length: int
    words: bool = False

    @property
    def reach(self) -> int:
        return self.length * 3 // 4

    @property
    def core(self) -> int:
        return self.length - self.reach

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts and the offsets of each text's."""
        data, offsets = text_buffer(texts)
        if not self.words:
            return data, offsets
        h, doc, _, _ = word_hashes(data, offsets, lower=False)
        return h, np.searchsorted(doc, np.arange(len(offsets)))

    def stored(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of binary values that were made from units."""
        data, offsets = text_buffer(column)
        return (np.ascontiguousarray(data).view("<u8"), offsets // 8) if self.words else (data, offsets)


BYTES = Window(400)
#: Contexts that a task should get; a class with more is split.
TASK_CONTEXTS = 3000
#: Bits of a packed value that hold a place; a longer buffer is taken in parts.
_PLACE = np.uint64(24)
_PART = 1 << 20

_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


class RangeHash:
    """Hashes of any ranges of at least ``gram`` units, 8 bytes or a word: equal units, equal values, in every buffer."""

    def __init__(self, data: np.ndarray):
        self.gram = 8 if data.dtype == np.uint8 else 1
        if self.gram == 8:
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            data = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))).view("<u8").ravel()
        self.grams = mix64(data, 11)
        with np.errstate(over="ignore"):
            sums = np.cumsum(self.grams * _power(_POWER, len(data)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of units ``first`` up to before ``last``."""
        with np.errstate(over="ignore"):
            x = (self.sums[last - self.gram + 1] - self.sums[first]) * _power(_INVERSE, len(self.sums))[first]
        return mix64(x ^ (last - first).astype(np.uint64), 12)


def contexts(data: np.ndarray, offsets: np.ndarray, window: Window):
    """Class, hash, text, first unit (in its text), number of windows, and the anchor's place in it, of all contexts."""
    length, reach, parts = window.length, window.reach, []
    if len(data) > _PART + length:
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for x in range(0, max(1, b - a - length + 1), _PART):
                parts.append((data[a + x : min(b, a + x + _PART + length - 1)], None, i, x))
    else:
        parts.append((data, offsets, 0, 0))
    out = []
    for piece, bounds, text, base in parts:
        if len(piece) < length:
            continue
        bounds = np.array([0, len(piece)]) if bounds is None else bounds
        hashes = RangeHash(piece)
        least = (hashes.grams >> _PLACE << _PLACE) | np.arange(len(piece), dtype=np.uint64)
        width = 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        count = np.maximum(np.diff(bounds) - length + 1, 0)
        starts = ragged(bounds[:-1], count)
        if not len(starts):
            continue
        anchor = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        first, b = starts[new], anchor[new]
        m = np.diff(np.append(new, len(starts)))
        owner = np.searchsorted(bounds, first, side="right") - 1
        h = mix64(hashes(first, first + m - 1 + length) ^ m.astype(np.uint64), 13)
        out.append((hashes(b, b + window.core), h, owner + text, first - bounds[owner] + base, m, b - first))
    if not out:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Strings of units as rows of numbers that sort as the strings do: words as they are, bytes by eights; and how many each has."""
    if words:
        n = lengths
        at = starts[:, None] + np.arange(max(1, int(n.max(initial=0))))
        rows = data[np.minimum(at, len(data) - 1)].astype(np.uint64)
    else:
        n = -(-lengths // 8)
        width = 8 * max(1, int(n.max(initial=0)))
        at = np.arange(width)
        raw = data[np.minimum(starts[:, None] + at, len(data) - 1)]
        raw[at >= lengths[:, None]] = 0
        rows = raw.view(">u8").astype(np.uint64)
    rows[np.arange(rows.shape[1]) >= n[:, None]] = 0
    return rows, n


def _agreement(rows: np.ndarray, order: np.ndarray, words: bool) -> np.ndarray:
    """In how many units each string agrees with the one before it in ``order``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    if words:
        out[1:] = first
        return out
    at = np.minimum(first, rows.shape[1] - 1)
    x = np.ascontiguousarray(np.take_along_axis(a, at[:, None], 1)[:, 0] ^ np.take_along_axis(b, at[:, None], 1)[:, 0])
    same = (x[:, None] >> (np.uint64(56) - np.arange(8, dtype=np.uint64) * np.uint64(8)) == 0).sum(1)
    out[1:] = 8 * first + np.where(first < rows.shape[1], same, 0)
    return out


def _ordered(strings: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The order of each list of strings (as ``_blocks`` has them), from the suffix array over all of them."""
    flat = [rows[np.arange(rows.shape[1]) < n[:, None]] for rows, n in strings]
    count = np.concatenate([n for _, n in strings])
    k = len(count)
    # Each string's numbers, then an end mark of its own, all less than the numbers; the last mark is the least.
    _, names = np.unique(np.concatenate(flat), return_inverse=True)
    ends = np.cumsum(count + 1) - 1
    text = np.empty(len(names) + k, np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = names + k
    text[ends] = k - 1 - np.arange(k)
    # Strings of no units have the same order as their marks.
    begins = np.full(len(text), -1, np.int64)
    begins[ends - count] = np.arange(k)
    found = begins[np.array(suffix_array(text.tolist()), np.int64)]
    found = found[found >= 0]
    out, before = [], 0
    for _, n in strings:
        out.append(found[(found >= before) & (found < before + len(n))] - before)
        before += len(n)
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, m: np.ndarray, anchor: np.ndarray, window: Window = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Context and place in it of every window that also starts in another of these contexts.

    ``m``: how many windows each context has; its units are ``length - 1`` more. ``anchor``: the place in it that its windows have in
    common. Windows of one context cannot be equal: they lie differently far before their anchor.
    """
    k = len(m)
    none = np.zeros(0, np.int64)
    if k < 2:
        return none, none
    starts, size = offsets[:-1], np.diff(offsets)
    back = data[::-1]
    right = _blocks(data, starts + anchor, np.minimum(size - anchor, window.length), window.words)
    left = _blocks(back, len(data) - starts - anchor, np.minimum(anchor, window.length), window.words)
    orders = _ordered([right, left])
    groups = []
    for (rows, _), order in zip((right, left), orders, strict=True):
        agree = np.empty(k, np.int64)
        agree[:] = _agreement(rows, order, window.words)
        groups.append((order, agree))
    low, high = anchor - m + 1, anchor
    found = []
    for p in range(int(low.min()), int(high.max()) + 1):
        some = np.flatnonzero((low <= p) & (p <= high))
        if len(some) < 2:
            continue
        name = []
        for (order, agree), need in zip(groups, (window.length - p, p), strict=True):
            g = np.empty(k, np.int64)
            g[order] = np.cumsum(agree < need)
            name.append(g[some])
        key = name[0] * (k + 1) + name[1]
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        hit = some[order[same]]
        found.append((hit, anchor[hit] - p))
    if not found:
        return none, none
    context, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, context))
    return context[order], place[order]


def halves(hashes: RangeHash, starts: np.ndarray, m: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, window: Window):
    """Contexts of classes whose windows lie from ``low`` up to before ``high`` before their anchors, split in the middle of that range.

    ``starts``: where each begins in the hashed units.

    Class, hash, source, first window's place in the source, number of windows, the anchor's place, and the new range, of each part.
    """
    middle = (low + high) // 2
    out = []
    for a, b in ((low, middle), (middle, high)):
        first = np.maximum(anchor - b + 1, 0)
        last = np.minimum(anchor - a, m - 1)
        some = np.flatnonzero(last >= first)
        a, b, first, n = a[some], b[some], first[some], (last - first + 1)[some]
        at = starts[some] + anchor[some]
        # What all windows of the range have in common.
        with np.errstate(over="ignore"):
            k = mix64(hashes(at - a, at + window.length - b + 1) ^ (a * 65536 + b).astype(np.uint64), 16)
        h = mix64(hashes(starts[some] + first, starts[some] + first + n - 1 + window.length) ^ n.astype(np.uint64), 13)
        out.append((k, h, some, first, n, anchor[some] - first, a, b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(context: np.ndarray, place: np.ndarray):
    """Context, first and last place of runs of neighbouring places."""
    new = np.ones(len(place), bool)
    new[1:] = (context[1:] != context[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    return context[first], place[first], place[last]


_RUNS = "k long, h long, first int, last int"
#: A context or a part of one: its class and hash, the context it is of, the part's first place there, and what ``halves`` says.
_PARTS = "k long, h long, whole_k long, whole_h long, at int, m int, b int, low int, high int, bytes binary"
_NAMES = [f.split()[0] for f in _PARTS.split(", ")]


def _promising(data: np.ndarray, offsets: np.ndarray, m: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, window: Window) -> np.ndarray:
    """Contexts of which some part shares a core with another context's after five splits; the others have no window in common."""
    hashes, owner, starts = RangeHash(data), np.arange(len(m)), offsets[:-1]
    for _ in range(5):
        k, _, some, first, m, b, low, high = halves(hashes, starts, m, b, low, high, window)
        _, back, n = np.unique(k, return_inverse=True, return_counts=True)
        stay = np.flatnonzero(n[back] > 1)
        owner, starts = owner[some[stay]], (starts[some] + first)[stay]
        m, b, low, high = m[stay], b[stay], low[stay], high[stay]
    return np.unique(owner)


def _settle(window: Window):
    def settle(group: pa.Table) -> pa.Table:
        data, offsets = window.stored(group.column("bytes"))
        k, h, at, m, b, low, high = (np.asarray(group.column(c)).astype(np.int64) for c in ("whole_k", "whole_h", "at", "m", "b", "low", "high"))
        some = _promising(data, offsets, m, b, low, high, window)
        size = np.diff(offsets)[some]
        data, offsets = data[ragged(offsets[some], size)], np.concatenate([[0], np.cumsum(size)])
        k, h, at, m, b = (x[some] for x in (k, h, at, m, b))
        c, first, last = _runs(*repeated_windows(data, offsets, m, b, window))
        del data
        release()
        return pa.table({"k": pa.array(k[c]), "h": pa.array(h[c]), "first": pa.array(at[c] + first, pa.int32()), "last": pa.array(at[c] + last, pa.int32())})

    return settle


def _split(window: Window):
    def split(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = window.stored(batch.column("bytes"))
            m, b, low, high, at = (np.asarray(batch.column(c)).astype(np.int64) for c in ("m", "b", "low", "high", "at"))
            k, h, some, first, n, anchor, a, z = halves(RangeHash(data), offsets[:-1], m, b, low, high, window)
            begin = offsets[some] + first
            raw = [data[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + n + window.length - 1).tolist(), strict=True)]
            whole = [batch.column(c).take(pa.array(some)) for c in ("whole_k", "whole_h")]
            small = [pa.array(x, pa.int32()) for x in (at[some] + first, n, anchor, a, z)]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(h.view(np.int64)), *whole, *small, pa.array(raw, pa.binary())], _NAMES)

    return split


def _settled(parts: DataFrame, window: Window) -> DataFrame:
    """Runs of windows of each context that occur in another one; ``parts`` are distinct contexts with ``size``, the contexts of their class."""
    count = F.count(F.lit(1))
    runs = None
    while True:
        few = parts.filter(F.col("size") <= TASK_CONTEXTS)
        tasks = max(1, few.count() // TASK_CONTEXTS)
        found = few.groupBy(F.pmod(F.xxhash64("k"), F.lit(tasks))).applyInArrow(_settle(window), _RUNS)
        runs = found if runs is None else runs.unionByName(found)
        many = parts.filter(F.col("size") > TASK_CONTEXTS)
        if many.isEmpty():
            return runs
        many = materialize(many.select(_NAMES).mapInArrow(_split(window), _PARTS), "parts")
        equal = materialize(many.groupBy("k", "h").agg(count.alias("n"), F.min(F.struct("whole_k", "whole_h", "at")).alias("one")), "equal")
        sizes = equal.groupBy("k").agg(count.alias("size")).filter("size > 1")
        copied = many.drop("bytes").join(equal.filter("n > 1").select("k", "h"), ["k", "h"])
        runs = runs.unionByName(copied.select(F.col("whole_k").alias("k"), F.col("whole_h").alias("h"), F.col("at").alias("first"), (F.col("at") + F.col("m") - 1).alias("last")))
        one = many.join(equal.join(sizes, "k").select("k", "h", "one", "size"), ["k", "h"]).filter((F.col("one.whole_k") == F.col("whole_k")) & (F.col("one.whole_h") == F.col("whole_h")) & (F.col("one.at") == F.col("at")))
        parts = materialize(one.select(*_NAMES, "size"), "parts")


#: Stands for a null doc_id in joins.
_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's identity is its doc_id and its text, so rows that share one of them stay apart."""
    text = F.coalesce("text", F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(True).alias("_"))
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"), rest.alias("rest"))


def _first_and_copied(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each context is the first of its equals, and whether it has any."""
    order = np.lexsort((h, k))
    new = np.ones(len(k), bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
    group = np.cumsum(new) - 1
    first, copied = np.zeros(len(k), bool), np.zeros(len(k), bool)
    first[order[new]] = True
    copied[order] = (np.bincount(group)[group] > 1) if len(k) else False
    return first, copied


def _occurrences(docs: DataFrame, window: Window) -> DataFrame:
    """Contexts of each text: ``k``, ``h``, ``doc_id``, ``t``, first window ``s``, windows ``m`` and anchor ``b``.

    Contexts that occur more than once in a batch of texts are repeats without further ado: what they cover is a row of its own for
    each run of neighbours, with the units from ``s`` up to before ``e`` and without ``k``; one of them stays as a context.
    """

    def anchor(batches):
        for batch in slices(batches, "text", 1 << 20):
            k, h, owner, s, m, b = contexts(*window.units(batch.column("text")), window)
            one, copied = _first_and_copied(k, h)
            stay = np.flatnonzero(one | ~copied)
            gone = np.flatnonzero(copied)
            o, x, n = owner[gone], s[gone], m[gone]
            new = np.ones(len(gone), bool)
            new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1] + n[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(gone)) - 1 if len(begin) else begin
            none = len(begin)
            column = lambda v, kind, none=none: pa.concat_arrays([pa.array(v, kind), pa.nulls(none, kind)])
            at = pa.array(np.concatenate([owner[stay], o[begin]]))
            ends = pa.concat_arrays([pa.nulls(len(stay), pa.int32()), pa.array((x + n - 1 + window.length)[end], pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [column(k.view(np.int64)[stay], pa.int64()), column(h.view(np.int64)[stay], pa.int64()), batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(np.concatenate([s[stay], x[begin]]), pa.int32()), column(m[stay], pa.int16()), column(b[stay], pa.int16()), ends],
                ["k", "h", "doc_id", "t", "s", "m", "b", "e"],
            )

    return docs.mapInArrow(anchor, "k long, h long, doc_id long, t long, s int, m short, b short, e int")


def _cut_out(window: Window):
    """The units of each wanted context of each text, as bytes."""

    def cut(batches):
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = window.units(batch.column("text"))
            for i, want in enumerate(batch.column("want").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                rows = [(x["k"], x["h"], x["m"], x["b"], raw[x["s"] : x["s"] + x["m"] + window.length - 1].tobytes()) for x in want]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["k", "h", "m", "b", "bytes"])

    return cut


def _few_words(words: int):
    """Texts with a string of the length of ``BYTES`` in which there are too few words for a run of ``words`` whole ones.

    Of two equal strings, the first and the last word may be whole in one text and part of a longer word in the other.
    """
    least = words + 2

    def scan(batches):
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = text_buffer(batch.column("text"))
            _, doc, starts, ends = word_hashes(data, offsets, lower=False)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            # From a word, or the text's begin, up to the end of ``least`` words after it, or the text's end.
            word = np.concatenate([np.arange(len(doc)), first[:-1] - 1])
            owner = np.concatenate([doc, np.arange(len(offsets) - 1)])
            begin = np.concatenate([starts, offsets[:-1]])
            inside = word + least < first[owner + 1]
            end = offsets[owner + 1].copy()
            end[inside] = ends[(word + least)[inside]]
            wide = np.bincount(owner, end - begin >= BYTES.length, len(offsets) - 1) > 0
            yield batch.filter(pa.array(wide))

    return scan


def repeated_spans(docs: DataFrame, window: Window) -> DataFrame:
    """Runs of windows that occur again: ``doc_id``, ``t`` and, for each context, ``spans`` (units a up to before b, and whether they are words), for keyed documents."""
    found = materialize(_occurrences(docs, window), "contexts")
    again = found.filter("k is null").select("doc_id", "t", F.array(F.struct(F.col("s").alias("a"), F.col("e").alias("b"), F.lit(window.words).alias("words"))).alias("spans"))
    found = found.filter("k is not null").drop("e")
    classes = materialize(found.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"), "classes")
    found = materialize(found.join(classes, "k"), "occurrences")
    distinct = materialize(found.groupBy("k", "h", "m", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "s")).alias("at")), "distinct")
    sizes = materialize(distinct.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    want = distinct.join(sizes, "k").select("k", "h", "m", "b", "at.*").groupBy("doc_id", "t").agg(F.collect_list(F.struct("k", "h", "m", "b", "s")).alias("want"))
    raw = docs.join(want.hint("merge"), ["doc_id", "t"]).select("text", "want").mapInArrow(_cut_out(window), "k long, h long, m int, b int, bytes binary")
    parts = raw.join(sizes, "k").select("k", "h", F.col("k").alias("whole_k"), F.col("h").alias("whole_h"), F.lit(0).alias("at"), "m", "b", F.lit(0).alias("low"), F.lit(window.reach).alias("high"), "bytes", "size")
    settled = _settled(materialize(parts, "parts"), window)
    copied = distinct.filter("n > 1").select("k", "h", F.lit(0).alias("first"), (F.col("m") - 1).cast("int").alias("last"))
    # A context with copies is covered whole; the others have all their runs in one row, so an occurrence stays one row.
    alone = settled.join(distinct.filter("n > 1").select("k", "h"), ["k", "h"], "left_anti")
    runs = copied.unionByName(alone).groupBy("k", "h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    spans = F.transform("runs", lambda r: F.struct((F.col("s") + r["first"]).alias("a"), (F.col("s") + r["last"] + window.length).alias("b"), F.lit(window.words).alias("words")))
    return found.join(materialize(runs, "runs"), ["k", "h"]).select("doc_id", "t", spans.alias("spans")).unionByName(again)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _in_bytes(spans: list, starts: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
    """Spans of a text whose words begin at ``starts``, as bytes of whole characters; a run of words takes the blanks up to the next word."""
    edge = [0, *starts[1:].tolist(), len(raw)]
    out = []
    for x in spans:
        a, b = (edge[x["a"]], edge[x["b"]]) if x["words"] else (x["a"], x["b"])
        while a > 0 and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, words: int | None = None, marked: int | None = None) -> DataFrame:
    """``doc_id``, ``kept`` (the bytes that remain), ``spans`` (removed runs), ``n_bytes``, ``n_marked`` and ``rest`` (the other columns) of every row.

    A byte goes if it lies in a string of 400 bytes that also starts anywhere else in the table, in the same text or
    in another row, which may be a copy of this one. Null texts are empty; texts shorter than 400 bytes stay as they
    are; a null doc_id stays null. The remaining bytes need not be valid UTF-8, since a run may start inside a character.

    With ``words``, runs of so many words go if they occur again, whatever their bytes and the blanks between them, and
    strings of 400 bytes are sought only in texts where one has fewer words, as in scripts without blanks; characters that
    such a string cuts go whole. With ``marked``, ``n_marked`` is the number of words of a text that lie in runs of so many
    words which occur again (else 0); these need not be long enough to go.
    """
    keyed = _keyed(docs)
    texts = keyed.select("doc_id", "t", "text")
    if words is None:
        spans = repeated_spans(texts, BYTES)
        if marked is not None:
            spans = spans.unionByName(repeated_spans(texts, Window(marked, words=True)))
    else:
        few = materialize(texts.mapInArrow(_few_words(words), texts.schema), "few-words")
        spans = repeated_spans(texts, Window(words, words=True)).unionByName(repeated_spans(few, BYTES))
    spans = spans.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def keep(batches):
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = text_buffer(batch.column("text"))
            kept, runs, count = [], [], []
            if words is not None:
                _, doc, starts, _ = word_hashes(data, offsets, lower=False)
                first = np.searchsorted(doc, np.arange(len(offsets)))
            for i, found in enumerate(batch.column("spans").to_pylist()):
                found = found or []
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if words is None:
                    merged = _merged([(x["a"], x["b"]) for x in found if not x["words"]])
                    count.append(sum(b - a for a, b in _merged([(x["a"], x["b"]) for x in found if x["words"]])))
                else:
                    merged = _merged(_in_bytes(found, starts[first[i] : first[i + 1]] - offsets[i], raw))
                    count.append(0)
                at, parts = 0, []
                for a, b in merged:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                runs.append([{"a": a, "b": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct({"a": pa.int32(), "b": pa.int32()}))), pa.array(count, pa.int64()), batch.column("rest")], ["doc_id", "n_bytes", "kept", "spans", "n_marked", "rest"])

    out = keyed.join(spans.hint("merge"), ["doc_id", "t"], "left").select("doc_id", "text", "spans", "rest").mapInArrow(keep, f"doc_id long, n_bytes long, kept binary, spans array<struct<a: int, b: int>>, n_marked long, rest {keyed.schema['rest'].dataType.simpleString()}")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), marked=51)
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("n_marked").alias("n_passage_words"))


ORACLE_SQL = {
    "op9_suffix_dedup": r"""
with p as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
pw as (select doc_id, i, md5(array_to_string(w[i + 1:i + 51], ' ')) as h from p, unnest(range(0, greatest(len(w) - 50, 0))) as r(i)),
pagain as (select h from pw group by h having count(*) > 1),
phit as (select doc_id, least(51, coalesce(lead(i) over (partition by doc_id order by i) - i, 51)) as c from pw where h in (select h from pagain)),
passages as (select doc_id, sum(c) as n_passage_words from phit group by doc_id),
d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, i, md5(substr(x, 2 * i + 1, 800)) as h from d, unnest(range(0, greatest(length(x) // 2 - 399, 0))) as r(i)),
again as (select h from w group by h having count(*) > 1),
hit as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -1000) > 400 as fresh from w where h in (select h from again)),
run as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as k from hit),
span as (select doc_id, min(i) as a, max(i) + 400 as b from run group by doc_id, k),
gap as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from span),
kept as (select doc_id, count(*) as n, sum(b - a) as gone, max(b) as last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as k from gap join d using (doc_id) group by doc_id)
select doc_id, coalesce(n_passage_words, 0)::bigint as n_passage_words, (length(x) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
 sha256(unhex(case when n is null then x else k || substr(x, 2 * last + 1) end)) as kept_sha256
from d left join kept using (doc_id) left join passages using (doc_id)
""",
}
