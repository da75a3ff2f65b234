"""Random draws that are functions of a row's key, a seed and a draw's number."""

from __future__ import annotations

import numpy as np

#: SplitMix64's fixed constants.
_GAMMA, _A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def combined(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A key for each pair of a key and a number."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + number.astype(np.uint64) * np.uint64(_A) + np.uint64(_GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_B)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _mixed(key: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """64 random bits for each key."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + np.uint64((_GAMMA * (seed * 1_000_003 + draw + 1)) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, _A), (27, _B)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def uniform(key: np.ndarray, seed: int, draw: int = 0) -> np.ndarray:
    """Uniform on (0, 1) for each key."""
    return _unit(_mixed(key, seed, draw))


#: Cumulative probabilities of a Poisson count with mean 1, and the counts by a draw's first 16 bits, NaN where those leave two.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
_COUNTS = np.searchsorted(_POISSON, np.arange(1 << 16) / (1 << 16), side="right").astype(float)
_COUNTS[_COUNTS != np.searchsorted(_POISSON, np.arange(1, (1 << 16) + 1) / (1 << 16), side="right")] = np.nan


def poisson(key: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """How often a bootstrap sample holds each key: independent Poisson counts with mean 1."""
    x = _mixed(key, seed, draw)
    out = _COUNTS[(x >> np.uint64(48)).view(np.int64)]
    rest = np.flatnonzero(np.isnan(out))
    out[rest] = np.searchsorted(_POISSON, _unit(x[rest]), side="right")
    return out


def normal(key: np.ndarray, seed: int, draw: int) -> np.ndarray:
    u, v = uniform(key, seed, 2 * draw), uniform(key, seed + 7, 2 * draw + 1)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
