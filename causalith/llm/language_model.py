"""Interpolated modified Kneser-Ney trigram model, counted in Spark and scored from memory-mapped hash arrays.

Words are 64-bit hashes. A first pass counts them and gives each a number. A second one counts trigrams of numbers: tasks
send sorted runs of them by range, and each range is merged by one task, which writes sorted arrays of n-gram hashes with
their counts to the shared folder and sends on what the next lower order needs: how many words each bigram continues,
then how many each word does, and the sums over each context. A range is that of a trigram's first two words, so their
sums are made where the trigrams are; if both words occur more than ``HOT`` times, it is that of all three, and the parts of the
sums meet in the next step. So no range grows with a frequent word. Counts have 64 bits and are exact; only the
stored arrays name an n-gram by part of its hash (see ``hash_arrays``).

The ranges' files are joined to ``SHARDS`` files of each kind, which workers map into memory: a fixed number, whatever the
corpus. N-grams of a slice of documents are looked up all at once, by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, mounted_dir, slices, table, text_buffer, word_hashes
from .hash_arrays import Shard, coded, join_files, keyed, load, packed, places, save, unpacked

#: The hash of a text's end, which is a word; and the number of what stands before a text's first word.
END, START = np.uint64(0x456E640000000002), 0
#: Bytes of text per range, tokens whose n-grams a task holds before it sends a run, files of each kind, and occurrences of
#: a word from which it is frequent.
RANGE_BYTES, RUN, SHARDS, HOT = 16 << 20, 1_000_000, 32, 200_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of each text, its end after them, and the texts' offsets."""
    data, offsets = text_buffer(texts)
    h, doc, _, _ = word_hashes(data, offsets)
    per = np.bincount(doc, minlength=len(offsets) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.full(bounds[-1], END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = h
    return out, bounds


def before(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word and the last but one before each token."""
    one, two = np.full(len(ids), START), np.full(len(ids), START)
    one[1:] = ids[:-1]
    one[bounds[:-1]] = START
    two[1:] = one[:-1]
    two[bounds[:-1]] = START
    return one, two


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a.astype(np.uint64), 41) ^ b.astype(np.uint64), 42)


def triple_key(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(pair ^ mix64(c.astype(np.uint64), 43), 44)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    # From the lower half: the upper bits are the buckets'.
    return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_ROWS = "kind string, range long, keys binary, blob binary, sums array<long>"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def _dealt(kind: str, range_: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A row for each range that some of the rows of numbers lie in; their order stays."""
    order = np.argsort(range_, kind="stable")
    r = range_[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(first.tolist(), np.append(first[1:], len(r)).tolist() if len(r) else [], strict=True):
        out.append((kind, int(r[a]), None, packed([c[order[a:b]] for c in columns]), None))
    return out


def _order(keys: list[np.ndarray]):
    """What puts rows of keys in ascending order: keys that fit 64 bits side by side are one number, others first get ranks."""
    width = [int(k.max()).bit_length() for k in keys]
    if sum(width) > 64 and len(keys) > 1:
        order, lead = _order(keys[:-1]), keys[:-1]
        new = np.zeros(len(lead[0]), np.int64)
        for k in lead:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        rank = np.empty_like(new)
        rank[order] = np.cumsum(new)
        keys, width = [rank, keys[-1]], [int(new.sum()).bit_length(), width[-1]]
        if sum(width) > 64:
            return np.lexsort(keys[::-1])
    one = keys[0].astype(np.uint64)
    for k, w in zip(keys[1:], width[1:], strict=True):
        one = (one << np.uint64(w)) | k.astype(np.uint64)
    return slice(None) if (one[1:] >= one[:-1]).all() else np.argsort(one)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of keys in ascending order, and the sums of their values."""
    if not len(keys[0]):
        return keys, values
    order = _order(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) for v in values]


def _gathered(group: pa.Table, kind: str, n_keys: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The merged runs of one kind."""
    blobs = [b for k, b in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True) if k == kind]
    parts = [unpacked(b) for b in blobs]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(n)]
    return _summed(columns[:n_keys], columns[n_keys:])


def _by_context(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of leading keys with the sum of their counts, and how many of these are 1, 2, and 3 or more."""
    return _summed(keys, [counts, *((np.minimum(counts, 3) == n).astype(np.int64) for n in (1, 2, 3))])


def _tally(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, how many there are, and their sum."""
    return [*np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist(), len(counts), int(counts.sum())]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of the counts 0, 1, 2, and 3 or more, from the counts of counts."""
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *(min(max(x, 0.05), k) for k, x in enumerate(d, 1))])


class Arrays:
    """The joined files of one kind; range r is the one numbered r // SHARDS of file r % SHARDS."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind, self.open = folder, kind, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _each(self, range_: np.ndarray):
        """Each file with the rows of its ranges and their ranges there; rows are dealt to the files in one pass."""
        shard = (range_ % SHARDS).astype(np.uint8)
        order = np.argsort(shard, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=SHARDS))]).tolist()
        inside = (range_ // SHARDS)[order]
        for s, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
            if a == z:
                continue
            if s not in self.open:
                self.open[s] = Shard(f"{self.folder}/{self.kind}.{s}")
            yield self.open[s], order[a:z], inside[a:z]

    def find(self, prefix: str, keys: np.ndarray, range_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key in its range's array, or -1, and its row of values, zeros where there is none."""
        place, out = np.empty(len(keys), np.int64), np.empty((len(keys), width), np.int64)
        for shard, at, r in self._each(range_):
            found = shard.find(prefix, keys[at], r)
            place[at] = found
            out[at] = shard.values(prefix, found, r)
        return place, out

    def values(self, prefix: str, place: np.ndarray, range_: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(place), width), np.int64)
        for shard, at, r in self._each(range_):
            out[at] = shard.values(prefix, place[at], r)
        return out


def _prefixed(prefix: str, *arrays: dict) -> dict:
    return {f"{prefix}{k}": v for a in arrays for k, v in a.items()}


_NO_KEYS, _NO_COUNTS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _join(spark, folder: str, kind: str, ranges: int, none: dict) -> None:
    """Join the files of all ranges of one kind, in tasks."""

    def join(batches):
        for batch in batches:
            for s in batch.column("id").to_pylist():
                join_files([f"{folder}/{kind}-{r}" for r in range(s, ranges, SHARDS)], f"{folder}/{kind}.{s}", none)
            yield batch

    spark.range(0, SHARDS, 1, SHARDS).mapInArrow(join, "id long").count()


class Vocabulary:
    """Numbers and counts of the words of a corpus."""

    def __init__(self, folder: str, ranges: int, sizes: list[int]):
        self.ranges, self.arrays = ranges, Arrays(folder, "word")
        self.base = np.concatenate([[START + 1], START + 1 + np.cumsum(sizes)])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word, -1 and 0 where it is unknown."""
        r = _range(hashes, self.ranges)
        place, count = self.arrays.find("w", hashes, r, 1)
        return np.where(place >= 0, self.base[r] + place, -1), count[:, 0]

    def at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range and place of words with these numbers."""
        r = np.searchsorted(self.base, ids, side="right") - 1
        return r, ids - self.base[r]


def _count_words(docs: DataFrame, folder: str, ranges: int) -> tuple[Vocabulary, int]:
    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            (h,), (n,) = _summed([np.concatenate([x for x, _ in held])], [np.concatenate([n for _, n in held])])
            held.clear()
            r = _range(h, ranges)
            order = np.argsort(r, kind="stable")
            cut = np.searchsorted(r[order], np.arange(ranges + 1))
            rows = []
            for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if b > a:
                    rows.append(("word", i, h[order[a:b]].tobytes(), packed([np.zeros(b - a, np.int64), n[order[a:b]]]), None))
            return _table(rows).to_batches()

        for batch in slices(batches, "text"):
            held.append(np.unique(tokens(batch.column("text"))[0], return_counts=True))
            if sum(len(x) for x, _ in held) > RUN:
                yield from send()
        if held:
            yield from send()

    def merge(group: pa.Table) -> pa.Table:
        i = group.column("range")[0].as_py()
        h = np.concatenate([np.frombuffer(x, "<u8") for x in group.column("keys").to_pylist()])
        n = np.concatenate([unpacked(x)[1] for x in group.column("blob").to_pylist()])
        (h,), (n,) = _summed([h], [n])
        save(f"{folder}/word-{i}", _prefixed("w", keyed(h, wide=True), coded(n)))
        return _table([("word", i, None, None, [len(n), int(n.sum())])])

    found = docs.select("text").mapInArrow(count, _ROWS).groupBy("range").applyInArrow(merge, _ROWS)
    seen = {r["range"]: r["sums"] for r in found.select("range", "sums").collect()}  # one row for each range
    _join(docs.sparkSession, folder, "word", ranges, _prefixed("w", keyed(_NO_KEYS, wide=True), coded(_NO_COUNTS)))
    sizes = [seen.get(i, [0, 0]) for i in range(ranges)]
    return Vocabulary(folder, ranges, [k for k, _ in sizes]), sum(n for _, n in sizes)


class Model:
    """A fitted model: where its arrays are, and a few totals."""

    def __init__(self, folder: str, ranges: int, words: Vocabulary, train_tokens: int, hot: int, sums: dict[str, list[int]]):
        self.ranges, self.words, self.train_tokens, self.hot = ranges, words, train_tokens, hot
        self.vocabulary = int(words.base[-1]) - 1
        self.triples, self.pairs, self.singles = (Arrays(folder, k) for k in ("triple", "pair", "single"))
        none = [0] * 6
        three, two, one = (sums.get(k, none) for k in ("three", "two", "one"))
        self.start = np.array(sums.get("start", [0] * 5), np.int64)
        self.d3, self.d2, self.d1 = (discounts(*x[:4]) for x in (three, two, one))
        self.continuations = one[5]
        left = float(self.d1[1:] @ np.array([one[0], one[1], one[4] - one[0] - one[1]]))
        self.uniform = (left / one[5] if one[5] else 1.0) / (self.vocabulary + 1)

    def log10(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's count in training and the log10 of its probability after the two tokens before it."""
        w, back = np.unique(words, return_inverse=True)
        ids, counts = self.words.find(w)
        frequent = np.append(counts > self.hot, True)  # the last stands for START
        single = np.zeros((len(w) + 1, 5), np.int64)
        known = np.flatnonzero(ids >= 0)
        r, place = self.words.at(ids[known])
        single[known] = self.singles.values("s", place, r, 5)
        single[len(w)] = self.start
        number = np.append(ids, START)
        one, two = (np.where(x == -7, len(w), x) for x in _shifted(back, bounds))
        p1 = np.where(ids >= 0, np.maximum(single[:-1, 0] - self.d1[np.minimum(single[:-1, 0], 3)], 0) / max(1, self.continuations) + self.uniform, self.uniform)[back]
        # Pairs of neighbours, and the one of two STARTs, serve as bigrams and as contexts.
        wide = np.int64(len(w) + 1)
        pair, pair_back = np.unique(np.append(one * wide + back, wide * wide - 1), return_inverse=True)
        a, b = pair // wide, pair % wide
        some = np.flatnonzero((number[a] >= 0) & (number[b] >= 0))
        key = np.zeros(len(pair), np.uint64)
        key[some] = pair_key(number[a[some]], number[b[some]])
        found = np.zeros((len(pair), 5), np.int64)
        r = _range(key[some], self.ranges)
        place, found[some, 1:] = self.triples.find("c", key[some], r, 4)
        found[some, 0] = self.pairs.values("a", place, r, 1)[:, 0]
        rest = some[place < 0]
        r = _range(key[rest], self.ranges)
        found[rest] = self.pairs.find("x", key[rest], r, 5)[1]
        total, left = _left(single[:, 1:], self.d2)
        p2 = _interpolated(found[pair_back[:-1], 0], total[one], left[one], self.d2, p1)
        context = np.full(len(words), pair_back[-1])
        later = np.ones(len(words), bool)
        later[bounds[:-1]] = False
        context[later] = pair_back[:-1][np.flatnonzero(later) - 1]
        triple, triple_back = np.unique(context * wide + back, return_inverse=True)
        c, x = triple // wide, triple % wide
        seen = np.flatnonzero((found[c, 1] > 0) & (number[x] >= 0))
        c, x = c[seen], x[seen]
        k = triple_key(key[c], number[x])
        r = _range(np.where(frequent[a[c]] & frequent[b[c]], k, key[c]), self.ranges)
        count = np.zeros(len(triple), np.int64)
        count[seen] = self.triples.find("t", k, r, 1)[1][:, 0]
        total, left = _left(found[:, 1:], self.d3)
        p3 = _interpolated(count[triple_back], total[context], left[context], self.d3, p2)
        return counts[back], np.log10(p3)


def _shifted(index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = before(index, bounds)
    first = np.zeros(len(index), bool)
    first[bounds[:-1]] = True
    one = np.where(first, -7, one)
    second = np.zeros(len(index), bool)
    second[1:] = first[:-1]
    return one, np.where(first | second, -7, two)


def _left(contexts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each context's total, and the share that the discounts leave for the lower order."""
    total = contexts[:, 0]
    return total, contexts[:, 1:] @ d[1:] / np.maximum(total, 1)


def _interpolated(count: np.ndarray, total: np.ndarray, left: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted relative frequency in the context plus what the discounts leave for the lower order; that alone without the context."""
    return np.where(total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(total, 1) + left * lower, lower)


def _named(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct numbers of a run's trigrams, and each column's places among them; a and b mostly are c moved on."""
    n, moved = len(c), lambda x, head: np.append(head, x[:-1])
    one = moved(c, START)
    odd_b, odd_a = np.flatnonzero(one != b), np.flatnonzero(moved(one, START) != a)
    own, code = np.unique(np.concatenate([c, b[odd_b], a[odd_a], [START]]), return_inverse=True)
    one = moved(code[:n], code[-1])
    two = moved(one, code[-1])
    one[odd_b], two[odd_a] = code[n : n + len(odd_b)], code[n + len(odd_b) : -1]
    return own, [two, one, code[:n]]


def fit(docs: DataFrame, hot: int = HOT) -> Model:
    """Count the n-grams of all ``text`` values; a null text is a document without words. ``hot`` changes where counts meet, not the model."""
    spark = docs.sparkSession
    docs = docs.select("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, -(-total // RANGE_BYTES))
    folder = mounted_dir(spark, "language-model")
    words, train_tokens = _count_words(docs, folder, ranges)

    def count(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def send():
            a, b, c, n = (np.concatenate([x[i] for x in held]) for i in range(4))
            held.clear()
            # Numbers of this run's words take 21 bits, so a trigram is one number.
            own, code = _named(a, b, c)
            code = [x.astype(np.uint64) for x in code]
            packed_, n_ = np.unique((code[0] << np.uint64(42)) | (code[1] << np.uint64(21)) | code[2], return_counts=True)
            mask = np.uint64((1 << 21) - 1)
            a_, b_, c_ = (own[((packed_ >> np.uint64(s)) & mask).astype(np.int64)] for s in (42, 21, 0))
            frequent = own == START
            frequent[code[2][n > hot].astype(np.int64)] = True
            at = lambda s: ((packed_ >> np.uint64(s)) & mask).astype(np.int64)
            spread = frequent[at(42)] & frequent[at(21)]
            pair = pair_key(a_, b_)
            r = _range(np.where(spread, triple_key(pair, c_), pair), ranges)
            rows = []
            for kind, some in (("triple", ~spread), ("spread", spread)):
                rows += _dealt(kind, r[some], [x[some] for x in (a_, b_, c_, n_)])
            return _table(rows).to_batches()

        size = 0
        for batch in slices(batches, "text"):
            h, bounds = tokens(batch.column("text"))
            w, back = np.unique(h, return_inverse=True)
            ids, n = words.find(w)
            one, two = before(ids[back], bounds)
            columns = two, one, ids[back], n[back]
            for x in range(0, len(h), RUN):
                part = tuple(c[x : x + RUN] for c in columns)
                if held and size + len(part[0]) > RUN:
                    yield from send()
                    size = 0
                held.append(part)
                size += len(part[0])
        if held:
            yield from send()

    def merge_triples(group: pa.Table) -> pa.Table:
        i = group.column("range")[0].as_py()
        (a, b, c), (n,) = _gathered(group, "triple", 3, 4)
        (a2, b2, c2), (n2,) = _gathered(group, "spread", 3, 4)
        context, sums = _by_context([a, b], n)
        key = pair_key(*context)
        order = np.argsort(key)
        arrays = _prefixed("c", keyed(key[order]), coded(np.stack(sums, 1)[order]))
        key = triple_key(pair_key(np.append(a, a2), np.append(b, b2)), np.append(c, c2))
        order = np.argsort(key)
        save(f"{folder}/triple-{i}", arrays | _prefixed("t", keyed(key[order]), coded(np.append(n, n2)[order])))
        rows = [("three", i, None, None, _tally(np.append(n, n2)))]
        context, sums = _by_context([a2, b2], n2)
        rows += _dealt("context", _range(pair_key(*context), ranges), [*context, *sums])
        low, (n,) = _summed([np.append(b, b2), np.append(c, c2)], [np.ones(len(c) + len(c2), np.int64)])
        rows += _dealt("low", _range(pair_key(*low), ranges), [*low, n])
        return _table(rows)

    def passed(group: pa.Table, kinds: tuple) -> list[tuple]:
        return [tuple(r[k] for k in _NAMES) for r in group.to_pylist() if r["kind"] in kinds]

    def merge_pairs(group: pa.Table) -> pa.Table:
        i = group.column("range")[0].as_py()
        (a, b), (n,) = _gathered(group, "low", 2, 3)
        (a2, b2), sums2 = _gathered(group, "context", 2, 6)
        try:
            arrays = load(f"{folder}/triple-{i}")
        except FileNotFoundError:
            arrays = _prefixed("c", keyed(_NO_KEYS), coded(np.zeros((0, 4), np.int64)))
        key = pair_key(a, b)
        place = places(arrays, "c", key)
        own = np.zeros(len(arrays["ccode"]), np.int64)
        own[place[place >= 0]] = n[place >= 0]
        # Pairs that are no context in this range: those before no word, and those whose trigrams lie in several ranges.
        out = place < 0
        (x, y), rows5 = _summed([np.append(a[out], a2), np.append(b[out], b2)], [np.append(n[out], np.zeros(len(a2), np.int64)), *(np.append(np.zeros(int(out.sum()), np.int64), s) for s in sums2)])
        other = pair_key(x, y)
        order = np.argsort(other)
        save(f"{folder}/pair-{i}", _prefixed("a", coded(own)) | _prefixed("x", keyed(other[order]), coded(np.stack(rows5, 1)[order])))
        rows = [*passed(group, ("three",)), ("two", i, None, None, _tally(n))]
        (first,), sums = _by_context([a], n)
        rows += _dealt("first", words.at(first)[0], [first, *sums])
        (last,), (k,) = _summed([b], [np.ones(len(b), np.int64)])
        rows += _dealt("last", words.at(last)[0], [last, k])
        return _table(rows)

    def merge_singles(group: pa.Table) -> pa.Table:
        j = group.column("range")[0].as_py()
        rows = passed(group, ("three", "two"))
        (first,), sums = _gathered(group, "first", 1, 5)
        (last,), (k,) = _gathered(group, "last", 1, 2)
        if j < 0:
            return _table([*rows, ("start", j, None, None, [0, *(int(s.sum()) for s in sums), 0])])
        if not len(first) and not len(last):
            return _table(rows)
        out = np.zeros((int(words.base[j + 1] - words.base[j]), 5), np.int64)
        out[last - words.base[j], 0] = k
        out[first - words.base[j], 1:] = np.stack(sums, 1)
        save(f"{folder}/single-{j}", _prefixed("s", coded(out)))
        return _table([*rows, ("one", j, None, None, _tally(k))])

    rows = docs.mapInArrow(count, _ROWS)
    for merge in (merge_triples, merge_pairs, merge_singles):
        rows = rows.groupBy("range").applyInArrow(merge, _ROWS)
    seen = rows.groupBy("kind").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(6))).collect()
    sums = {r["kind"]: [int(r[f"s{i}"] or 0) for i in range(6)] for r in seen}
    if "start" in sums:
        sums["start"] = sums["start"][:5]
    pair = _prefixed("a", coded(_NO_COUNTS)) | _prefixed("x", keyed(_NO_KEYS), coded(np.zeros((0, 5), np.int64)))
    _join(spark, folder, "triple", ranges, _prefixed("c", keyed(_NO_KEYS), coded(np.zeros((0, 4), np.int64))) | _prefixed("t", keyed(_NO_KEYS), coded(_NO_COUNTS)))
    _join(spark, folder, "pair", ranges, pair)
    _join(spark, folder, "single", ranges, _prefixed("s", coded(np.zeros((0, 5), np.int64))))
    return Model(folder, ranges, words, train_tokens, hot, sums)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    A null or empty text is its end alone. ``base_score`` is the add-one unigram model's; perplexity is
    ``10 ** (-score / n_tokens)``. Equal texts have equal scores. A model of no documents scores all tokens as unknown.
    """
    base = np.log10(float(model.train_tokens + model.vocabulary + 1))

    def rate(batches):
        for batch in slices(batches, "text", 4 << 20):
            words, bounds = tokens(batch.column("text"))
            count, p = model.log10(words, bounds)
            add = lambda x: np.add.reduceat(x, bounds[:-1])
            cols = [np.diff(bounds), add((count > 0).astype(np.int64)), np.full(batch.num_rows, model.train_tokens, np.int64), add(np.log10(count + 1.0) - base), add(p)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    scored = score(docs, fit(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
