"""Word-shingle sets and their SetSketch registers.

A set's register i holds floor(1 - log_b(x_i)), cut to 0 .. q + 1, where x_i is the least of independent exponential
variates of rate ``RATE`` that a hash draws for the set's elements. Registers of a union are the registers' maxima, and
two sets' registers agree about as often as the sets' Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, word_hashes

#: Parameters that SetSketch's authors recommend for two-byte registers.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Registers in a band, and the probability with which a pair at the threshold may share no band.
BAND, MISS = 5, 1e-6


def bands_for(percent: int) -> int:
    """Bands that pairs of a similarity of ``percent`` miss with a probability of at most ``MISS``."""
    return int(np.ceil(np.log(MISS) / np.log1p(-((min(percent, 99) / 100) ** BAND))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all ``width``-word shingles of each text, and the texts' offsets in them.

    A text of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    h, doc, _, _ = word_hashes(data, offsets)
    docs = len(offsets) - 1
    words = np.bincount(doc, minlength=docs)
    ends = np.cumsum(words)
    starts = ends - words
    n = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    owner = np.repeat(np.arange(docs), n)
    first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    last = ends[owner]
    s = mix64(np.minimum(words[owner], width).astype(np.uint64), 3)
    for k in range(width):
        at = first + k
        inside = at < last
        s = np.where(inside, mix64(s ^ h[np.minimum(at, len(h) - 1)], 4), s) if len(h) else s
    order = np.lexsort((s, owner))
    s = s[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[fresh], minlength=docs)
    return s[fresh], np.concatenate([[0], np.cumsum(counts)])


def registers(sets: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Two-byte SetSketch registers of each set, one row per set; those of an empty set are 0."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, m), np.uint16)
    if not len(full):
        return out
    odd = mix64(np.arange(m, dtype=np.uint64), 5) | np.uint64(1)
    least = np.empty((len(full), m), np.uint64)
    starts = offsets[full]
    folded = sets ^ (sets >> np.uint64(32))
    for i in range(m):
        with np.errstate(over="ignore"):
            x = folded * odd[i]
            # The product's high half depends on all lower bits.
            least[:, i] = np.minimum.reduceat(x ^ (x << np.uint64(29)), starts)
    u = (least.astype(np.float64) + 1.0) / 18446744073709551617.0
    x = -np.log1p(-u) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers, one row per set."""
    n, count = len(regs), regs.shape[1] // BAND
    bands = regs.reshape(n, count, BAND).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(count, dtype=np.uint64), 6), (n, count)).copy()
    for k in range(BAND):
        key = mix64(key ^ bands[:, :, k], 7)
    return key


def fingerprints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits for each set: sums of two mixes of its elements."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            for i in range(2):
                out[full, i] = np.add.reduceat(mix64(sets, 8 + i), offsets[full])
    return out


def likelihood_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows whose sets' sizes are known.

    Of the registers, those greater in a, greater in b and equal are counted. For sizes u and v (scaled to u + v = 1) and
    similarity J, a register is greater in a with probability p_b(u - v J), greater in b with p_b(v - u J), where
    p_b(x) = -log_b(1 - x (b - 1) / b); the likelihood's maximum is found by golden-section search.
    """
    plus = (a > b).sum(-1).astype(np.float64)
    minus = (a < b).sum(-1).astype(np.float64)
    same = a.shape[-1] - plus - minus
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    top = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    c, log_b = (BASE - 1) / BASE, np.log(BASE)

    def value(j):
        p = -np.log1p(-np.maximum(u - v * j, 0) * c) / log_b
        q = -np.log1p(-np.maximum(v - u * j, 0) * c) / log_b
        tiny = 1e-12
        return plus * np.log(np.maximum(p, tiny)) + minus * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    low, high, g = np.zeros_like(top), top.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(24):
        x, y = high - g * (high - low), low + g * (high - low)
        left = value(x) > value(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2
