"""Document quality by Bradley-Terry ranking.

A document's score is linear in features of its whole text. The weights come from preference pairs, a document labelled
good before one labelled bad: the probability of the preference is the logistic function of the score difference, and
Newton's method minimises the logistic loss on the pairs' feature differences. Scores are cut at the quantile that
leaves out as large a share of the labelled documents as are labelled bad, and mapped to 0 .. 1 so that this cut
lies at a given value.

All labelled documents take part in the bins' edges, the pairs, the cut and the slope. They are seen in sums over rows: the
driver solves for the weights, features and scores are computed where the documents are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.frame import ranked
from .common import materialize, mix64, slices, table, text_buffer, word_hashes

#: The least number of pairs, as far as there are so many, and bins per feature.
PAIRS, BINS = 40_000, 10
#: Partial sums that come to the driver at once.
PARTS = 32
#: The score that documents at the cut get.
CUT = 0.3

#: Classes of bytes: lower case, upper case, digit, blank, line feed, sentence ends, comma, exclamation and question
#: marks, quotes and brackets, bars, other ASCII signs, first bytes of longer characters, later bytes, controls.
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".:;", b",", b"!?", b"\"'()[]", b"|<>{}\\/_=", b"#$%&*+-@^`~")):
    _CLASS[list(_chars)] = _k
_CLASS[0xC0:] = 11
_CLASS[0x80:0xC0] = 12
_CLASS[[x for x in range(32) if x not in (9, 10, 13)] + [127]] = 13
_CLASSES = 14


def _distinct(owner: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its most frequent one occurs."""
    if not len(values):
        return np.zeros(docs), np.zeros(docs)
    # One sort of 64 bits: the document above, the value's hash below.
    bits = max(1, int(docs).bit_length())
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (values >> np.uint64(bits)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    runs = np.diff(np.append(first, len(key)))
    doc = (key[first] >> np.uint64(64 - bits)).astype(np.int64)
    top = np.zeros(docs)
    np.maximum.at(top, doc, runs)
    return np.bincount(doc, minlength=docs).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text; all are finite, also of empty texts."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    n = np.maximum(size, 1)
    at = np.repeat(np.arange(docs) * _CLASSES, size)
    kinds = np.bincount(at + _CLASS[data], minlength=docs * _CLASSES).reshape(docs, _CLASSES)
    h, doc, starts, ends = word_hashes(data, offsets)
    words = np.bincount(doc, minlength=docs)
    w = np.maximum(words, 1)
    length = ends - starts
    distinct, top = _distinct(doc, h, docs)
    short = np.bincount(doc, length <= 3, docs)
    long_ = np.bincount(doc, length >= 16, docs)
    capital = np.bincount(doc, (_CLASS[data[starts]] == 1) if len(starts) else None, docs) if len(starts) else np.zeros(docs)
    signs = np.bincount(doc, _CLASS[data[ends - 1]] >= 7, docs) if len(starts) else np.zeros(docs)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stutter = np.bincount(doc, same, docs)
    triple, triples, triple_top = np.zeros(docs), np.ones(docs), np.zeros(docs)
    if len(h) > 2:
        inside = doc[2:] == doc[:-2]
        key = mix64(mix64(h[:-2] ^ np.uint64(1)) ^ mix64(h[1:-1], 1) ^ mix64(h[2:], 2))[inside]
        owner = doc[2:][inside]
        triple, triple_top = _distinct(owner, key, docs)
        triples = np.maximum(np.bincount(owner, minlength=docs), 1)
    # A line's hash is the sum of its words' hashes.
    line = np.cumsum(data == 10)
    line_of = line[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])])) if len(starts) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(h, new) if len(new) else np.zeros(0, np.uint64)
    lines, line_top = _distinct(doc[new], mix64(sums), docs)
    all_lines = np.bincount(doc[new], minlength=docs)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 11], 1)
    bits = kinds / n[:, None]
    entropy = -(bits * np.log(np.maximum(bits, 1e-12))).sum(1)
    columns = [
        np.log1p(size), np.log1p(words), size / w, entropy,
        *(kinds[:, k] / n for k in range(_CLASSES)),
        kinds[:, 1] / letters, short / w, long_ / w, capital / w, signs / w, stutter / w,
        distinct / w, distinct / np.sqrt(w), top / w, 1 - triple / triples * (words > 2), triple_top / triples,
        np.log1p(all_lines), 1 - lines / np.maximum(all_lines, 1), line_top / np.maximum(all_lines, 1), words / np.maximum(all_lines, 1),
        kinds[:, 5] / w,
    ]
    return np.stack(columns, 1).astype(np.float64)


class Ranker:
    """Weights of the features' bins, the scores' slope and cut."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, slope: float, cut: float):
        self.edges, self.weights, self.slope, self.cut = edges, weights, slope, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _design(x, self.edges) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each feature as how far the value has come through each bin between the edges: piecewise linear in the value."""
    low, high = edges[:, :-1], edges[:, 1:]
    width = high - low
    z = (x[:, :, None] - low) / np.where(width > 0, width, 1)
    return np.where(width > 0, np.clip(z, 0, 1), (x[:, :, None] > low).astype(float)).reshape(len(x), -1)


def _total(df: DataFrame, f) -> np.ndarray:
    """What ``f`` gives for each batch, added up over all rows; at most ``PARTS`` arrays come to the driver."""

    def partial(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                total = f(batch) if total is None else total + f(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([list(total.shape)], pa.list_(pa.int32())), pa.array([np.asarray(total, float).ravel()], pa.list_(pa.float64()))], ["part", "shape", "v"])

    got = df.coalesce(PARTS).mapInArrow(partial, "part int, shape array<int>, v array<double>").toArrow().sort_by("part")
    arrays = [np.asarray(v.values).reshape(s) for v, s in zip(got.column("v"), got.column("shape").to_pylist(), strict=True)]
    return sum(arrays)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, -1)


def _newton(df: DataFrame, f, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights that minimise the mean logistic loss of preferences ``f(batch) @ w > 0`` over all rows, plus a ridge."""
    w = None
    for _ in range(steps):

        def sums(batch, w=w):
            d = f(batch)
            p = 1 / (1 + np.exp(np.clip(d @ (np.zeros(d.shape[1]) if w is None else w), -60, 60)))
            return np.vstack([(d.T * (p * (1 - p))) @ d, d.T @ p, np.full(d.shape[1], len(d))])

        s = _total(df, sums)
        n = s[-1, 0]
        w = np.zeros(s.shape[1]) if w is None else w
        step = np.linalg.solve(s[:-2] / n + ridge * np.eye(len(w)), -s[-2] / n + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


_SIGN = np.uint64(1 << 63)


def _places(df: DataFrame, f, places: list[int]) -> np.ndarray:
    """Values at ``places`` (from 0) of each sorted column of ``f(batch)``, found byte by byte: each pass counts the next byte of all rows."""
    rest: np.ndarray = np.array(places)[None, :]
    prefix: np.ndarray | None = None
    for shift in range(56, -1, -8):

        def counts(batch, shift=shift, prefix=prefix):
            # Bits of doubles in the order of their values.
            u = (f(batch) + 0.0).view(np.uint64)
            u = np.where(u & _SIGN, ~u, u | _SIGN)
            at = ((u >> np.uint64(shift)) & np.uint64(255)).astype(np.int64) + np.arange(u.shape[1]) * 256
            mine = [slice(None) if prefix is None else (u >> np.uint64(shift + 8)) == prefix[:, q] for q in range(len(places))]
            return np.stack([np.bincount(at[m].ravel(), minlength=u.shape[1] * 256).reshape(-1, 256) for m in mine], 1)

        upto = _total(df, counts).cumsum(2)
        byte = (upto <= rest[:, :, None]).sum(2)
        before = np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, :, None], 2)[:, :, 0]
        rest = rest - np.where(byte > 0, before, 0)
        prefix = byte.astype(np.uint64) if prefix is None else (prefix << np.uint64(8)) | byte.astype(np.uint64)
    return np.where(prefix & _SIGN, prefix ^ _SIGN, ~prefix).view(np.float64)


def _pairs(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """A good (``g``) and a bad (``b``) document a row: every labelled one takes part, with several partners where there are few."""
    order = [F.xxhash64("doc_id"), "doc_id", "x"]
    many, few = ((1, 0) if good >= bad else (0, 1))
    size, least = max(good, bad), min(good, bad)
    rounds = min(least, max(1, -(-PAIRS // size)))
    partner = F.pmod(F.col("i") + F.col("r") * (least // rounds), F.lit(least))
    left = ranked(rows.filter(F.col("quality") == many).select("doc_id", "x"), order, "i").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    right = ranked(rows.filter(F.col("quality") == few).select("doc_id", "x"), order, "i").select("i", F.col("x").alias("y"))
    both = left.select("x", partner.alias("i")).join(right, "i")
    return materialize(both.select(F.col("x" if many else "y").alias("g"), F.col("y" if many else "x").alias("b")), "pairs")


def fit_ranker(rows: DataFrame, ridge: float = 1e-3) -> Ranker:
    """Fit on all ``rows`` (features ``x``, ``quality`` 0 or 1). With one label alone every document gets the same side of the cut."""
    sizes = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        n = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
        return Ranker(np.zeros((n, BINS + 1)), np.zeros(n * BINS), 1.0, 0.0 if good or not bad else 10.0)
    edges = _places(rows, _matrix, [k * (good + bad - 1) // BINS for k in range(BINS + 1)])
    w = _newton(_pairs(rows, good, bad), lambda b: _design(_matrix(b, "g"), edges) - _design(_matrix(b, "b"), edges), ridge)
    raw = lambda b: _design(_matrix(b), edges) @ w
    # Between the two scores that the quantile separates, nearer to the lower: a good document costs more than a bad one.
    below, above = _places(rows, lambda b: raw(b)[:, None], [bad - 1, bad])[0]
    cut = float(below + (above - below) / 4)
    # The slope of a logistic curve of the labels over the scores.
    one = _newton(rows, lambda b: np.where(np.asarray(b.column("quality")) == 1, 1, -1)[:, None] * np.stack([(z := raw(b)) - cut, np.ones(len(z))], 1), 1e-6)
    return Ranker(edges, w, max(float(one[0]), 1e-3), cut)


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``quality`` and features ``x`` of all labelled documents."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))

    def extract(batches):
        for batch in slices(batches, "text"):
            x = features(*text_buffer(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    # Texts are not shuffled: features are computed where the documents are, and meet their labels.
    got = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(extract, "doc_id long, x array<double>")
    return materialize(got.join(known, "doc_id").select("doc_id", "quality", "x"), "labelled")


def rank_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``docs`` with ``score``; null and empty texts have a score too. A column of that name is replaced."""
    kept = docs.drop("score")

    def rate(batches):
        for batch in slices(batches, "text"):
            yield batch.append_column("score", pa.array(ranker.score(features(*text_buffer(batch.column("text"))))))

    return kept.mapInArrow(rate, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(column: str = "doc_id", fold: int = 5):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % fold == 0


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from the labelled documents that are not held out."""
    return fit_ranker(labelled_features(docs, labels.filter(~held_out())))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = train(docs, table(spark, sf_dir, "labels"))
    out = rank_quality(docs.select("doc_id", "text"), ranker).select("doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
