"""Sorted hash arrays in files that workers map into memory, and compact runs of numbers for shuffles.

A shard file holds the arrays of some ranges, one range after the other. Of a sorted array of 64-bit keys the upper bits
give a bucket of about eight keys; a table has each bucket's first place, and the next 32 bits are stored for each
key. So a key takes four and a half bytes, and a key that is not there is taken for another with a probability of 2e-9.
Values are a byte each, the number of a row in a table of the 255 most frequent ones; all others are listed whole.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)
#: Single numbers from which on a number is listed whole.
_SMALL = 4096


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers of one length; the first ascends."""
    out = [np.array([len(columns[0])], "<i8").tobytes()]
    for i, c in enumerate(columns):
        c = np.diff(c, prepend=0) if i == 0 else c
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T)
        raw = _CODEC.compress(planes.tobytes(), asbytes=True)
        out.append(np.array([width, len(raw)], "<i8").tobytes() + raw)
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    while at < len(raw):
        width, size = (int(x) for x in np.frombuffer(raw, "<i8", 2, at))
        planes = np.frombuffer(_CODEC.decompress(raw[at + 16 : at + 16 + size], n * width, asbytes=True), np.uint8).reshape(width, n)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = planes.T
        c = wide.view("<u8").ravel().astype(np.int64)
        out.append(np.cumsum(c) if not out else c)
        at += 16 + size
    return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays at multiples of 8 bytes after a header; a whole file or none, also when two attempts of a task write it."""
    head, at, blocks = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [at, str(a.dtype), list(a.shape)]
        blocks.append(raw + b"\0" * (-len(raw) % 8))
        at += len(blocks[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    part = f"{path}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.array([len(text)], "<i8").tobytes() + text + b"".join(blocks))
    os.replace(part, path)


def load(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        raw = f.read()
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = json.loads(raw[8 : 8 + n])
    return {k: np.frombuffer(raw, kind, int(np.prod(shape)), 8 + n + at).reshape(shape) for k, (at, kind, shape) in head.items()}


def keyed(keys: np.ndarray, wide: bool = False) -> dict[str, np.ndarray]:
    """The arrays of sorted distinct keys; with ``wide`` all bits of a key are stored."""
    bits = max(1, len(keys).bit_length() - 3)
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype("<u4")
    rest = keys << np.uint64(bits)
    return {"bits": np.array([bits], "<u4"), "first": first, "rest": rest.astype("<u8") if wide else (rest >> np.uint64(32)).astype("<u4")}


def _search(table: np.ndarray, rests: np.ndarray, first: np.ndarray, rest: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the keys of its array, or -1; ``first`` and ``rest`` are where the arrays begin in ``table`` and ``rests``."""
    bucket = (keys >> (np.uint64(64) - bits)).astype(np.int64)
    low, high = table[first + bucket].astype(np.int64), table[first + bucket + 1].astype(np.int64)
    end = high.copy()
    want = keys << bits
    want = want if rests.dtype == np.uint64 else (want >> np.uint64(32)).astype(np.uint32)
    open_ = np.flatnonzero(low < high)
    while open_.size:
        a, z = low[open_], high[open_]
        middle = (a + z) >> 1
        less = rests[rest[open_] + middle] < want[open_]
        a, z = np.where(less, middle + 1, a), np.where(less, z, middle)
        low[open_], high[open_] = a, z
        open_ = open_[a < z]
    hit = np.flatnonzero(low < end)
    hit = hit[rests[rest[hit] + low[hit]] == want[hit]]
    out = np.full(len(keys), -1, np.int64)
    out[hit] = low[hit]
    return out


def places(arrays: dict[str, np.ndarray], prefix: str, keys: np.ndarray) -> np.ndarray:
    """The place of each key in arrays that ``load`` gave, or -1."""
    none = np.zeros(len(keys), np.int64)
    bits = np.full(len(keys), arrays[f"{prefix}bits"][0], np.uint64)
    return _search(arrays[f"{prefix}first"], arrays[f"{prefix}rest"], none, none, bits, keys)


def coded(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of rows of numbers."""
    values = values.astype("<i8")
    values = values if values.ndim == 2 else values[:, None]
    if not len(values):
        return {"code": np.zeros(0, np.uint8), "table": np.zeros((0, values.shape[1]), "<i8"), "odd": np.zeros(0, "<i8"), "whole": np.zeros((0, values.shape[1]), "<i8")}
    if values.shape[1] == 1 and values.min() >= 0:
        least = np.minimum(values[:, 0], _SMALL)
        n = np.bincount(least, minlength=_SMALL + 1)[:-1]
        top = np.argsort(-n, kind="stable")[:255]
        top = top[n[top] > 0]
        name = np.full(_SMALL + 1, 255, np.uint8)
        name[top] = np.arange(len(top))
        code = name[least]
        odd = np.flatnonzero(code == 255)
        return {"code": code, "table": top.astype("<i8")[:, None], "odd": odd.astype("<i8"), "whole": values[odd]}
    mixed = np.zeros(len(values), np.uint64)
    with np.errstate(over="ignore"):
        for c in values.T:
            mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    _, back, n = np.unique(mixed, return_inverse=True, return_counts=True)
    one = np.empty(len(n), np.int64)
    one[back] = np.arange(len(back))
    top = np.argsort(-n, kind="stable")[:255]
    table = values[one[top]]
    name = np.full(len(n), 255)
    name[top] = np.arange(len(top))
    code = name[back]
    code[(table[np.minimum(code, len(table) - 1)] != values).any(1)] = 255
    odd = np.flatnonzero(code == 255)
    return {"code": code.astype(np.uint8), "table": table, "odd": odd.astype("<i8"), "whole": values[odd]}


def join_files(paths: list[str], to: str, none: dict[str, np.ndarray]) -> None:
    """One file of several, with the arrays ``none`` for those that are missing. The parts go when the whole is there."""
    if not os.path.exists(to):
        part, table = f"{to}-{uuid.uuid4().hex}", []
        with open(part, "wb") as f:
            for p in paths:
                if not os.path.exists(p):
                    save(p, none)
                with open(p, "rb") as g:
                    raw = g.read()
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                base = f.tell()
                table.append({k: [base + at, kind, shape] for k, (at, kind, shape) in json.loads(raw[8 : 8 + n]).items()})
                f.write(raw[8 + n :])
            text = json.dumps(table).encode()
            f.write(text + b" " * (-len(text) % 8) + np.array([len(text) + -len(text) % 8], "<i8").tobytes())
        os.replace(part, to)
    for p in paths:
        if os.path.exists(p):
            os.remove(p)


class Shard:
    """The arrays of a file that ``join_files`` made, mapped into memory; ``range_`` says in which of its ranges a key lies."""

    def __init__(self, path: str):
        size = os.path.getsize(path)
        self.bytes = np.asarray(np.memmap(path, np.uint8, "r"))
        n = int(self.bytes[size - 8 :].view("<i8")[0])
        self.table = json.loads(self.bytes[size - 8 - n : size - 8].tobytes())
        self.words = self.bytes[: size // 4 * 4].view("<u4")
        self.wide_words = self.bytes[: size // 8 * 8].view("<u8")
        self.begins: dict[str, np.ndarray] = {}
        self.bits: dict[str, np.ndarray] = {}

    def _begin(self, name: str) -> np.ndarray:
        if name not in self.begins:
            self.begins[name] = np.array([t[name][0] for t in self.table], np.int64)
        return self.begins[name]

    def find(self, prefix: str, keys: np.ndarray, range_: np.ndarray) -> np.ndarray:
        """The place of each key in its range's array, or -1."""
        if prefix not in self.bits:
            self.bits[prefix] = self.words[self._begin(f"{prefix}bits") // 4].astype(np.uint64)
        wide = self.table[0][f"{prefix}rest"][1] == "uint64"
        first, rest = self._begin(f"{prefix}first")[range_] // 4, self._begin(f"{prefix}rest")[range_] // (8 if wide else 4)
        return _search(self.words, self.wide_words if wide else self.words, first, rest, self.bits[prefix][range_], keys)

    def values(self, prefix: str, place: np.ndarray, range_: np.ndarray) -> np.ndarray:
        """Rows of values at places; zeros where the place is -1."""
        width = self.table[0][f"{prefix}table"][2][1]
        out = np.zeros((len(place), width), np.int64)
        some = np.flatnonzero(place >= 0)
        if not len(some):
            return out
        begin = self._begin(f"{prefix}code")
        code = self.bytes[begin[range_[some]] + place[some]].astype(np.int64)
        tables = [self._array(t, f"{prefix}table") for t in self.table]
        base = np.cumsum([0, *map(len, tables)])
        plain = code < 255
        out[some[plain]] = np.concatenate(tables)[base[range_[some[plain]]] + code[plain]]
        rare = some[~plain]
        for r in np.unique(range_[rare]).tolist():
            at = rare[range_[rare] == r]
            odd, whole = self._array(self.table[r], f"{prefix}odd"), self._array(self.table[r], f"{prefix}whole")
            out[at] = whole[np.searchsorted(odd, place[at])]
        return out

    def _array(self, table: dict, name: str) -> np.ndarray:
        at, kind, shape = table[name]
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        return self.bytes[at : at + n].view(kind).reshape(shape)
