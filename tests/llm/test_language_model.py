"""The language model's sorts and lookups against plain ones."""

import numpy as np
import pytest

from causalith.llm import language_model
from causalith.llm.hash_arrays import coded, join_files, keyed, save


@pytest.mark.parametrize("bits", [4, 21, 30, 40, 62])
def test_rows_of_keys_are_sorted_as_numbers(monkeypatch, bits):
    """Three columns are summed as plain Python does it, without a sort for each column where their ranks fit 64 bits."""
    rng = np.random.default_rng(bits)
    some = rng.integers(0, 1 << bits, 40)
    keys, n = [some[rng.integers(0, 40, 5000)] for _ in range(3)], rng.integers(1, 9, 5000)
    want: dict = {}
    for *key, x in zip(*keys, n, strict=True):
        want[tuple(key)] = want.get(tuple(key), 0) + x

    def refused(_):
        raise AssertionError("a sort for each column")

    if bits < 60:
        monkeypatch.setattr(np, "lexsort", refused)
    got, (sums,) = language_model._summed(keys, [n])
    assert dict(zip(zip(*got, strict=True), sums, strict=True)) == want
    assert list(zip(*got, strict=True)) == sorted(want)


def test_keys_are_dealt_to_their_files_once(tmp_path):
    """Each key is found in its own range's file, with its values, and others are not."""
    rng = np.random.default_rng(2)
    ranges, shards = 70, language_model.SHARDS
    keys = np.unique(rng.integers(1, 1 << 63, 9000).astype(np.uint64))
    r = language_model._range(keys, ranges)
    values = np.stack([np.arange(len(keys)) % 7, np.arange(len(keys))], 1)
    for i in range(ranges):
        save(f"{tmp_path}/k-{i}", {f"k{k}": v for a in (keyed(keys[r == i]), coded(values[r == i])) for k, v in a.items()})
    for s in range(shards):
        join_files([f"{tmp_path}/k-{i}" for i in range(s, ranges, shards)], f"{tmp_path}/k.{s}", {})
    arrays = language_model.Arrays(str(tmp_path), "k")
    asked = rng.permutation(np.append(keys, keys + np.uint64(1 << 40)))
    place, found = arrays.find("k", asked, language_model._range(asked, ranges), 2)
    row = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    own = keys[row] == asked
    assert ((place >= 0) == own).all()
    assert (found[own] == values[row[own]]).all() and not found[~own].any()


def test_a_run_is_named_as_its_columns():
    """Places of moved columns are those of their numbers, also where texts begin and where runs are cut."""
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 9, 500), rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    b[100:], a[200:] = c[99:-1], c[198:-2]
    own, codes = language_model._named(a, b, c)
    assert all((own[code] == x).all() for code, x in zip(codes, (a, b, c), strict=True))


@pytest.mark.parametrize("most", [3, 5000, 1 << 40])
def test_values_are_read_back(tmp_path, most):
    values = np.random.default_rng(4).integers(0, most, 3000)
    save(f"{tmp_path}/k-0", {f"k{k}": v for k, v in coded(values).items()})
    join_files([f"{tmp_path}/k-0"], f"{tmp_path}/k.0", {})
    place = np.append(np.arange(3000), -1)
    assert language_model.Arrays(str(tmp_path), "k").values("k", place, np.zeros(3001, np.int64), 1)[:, 0].tolist() == [*values.tolist(), 0]
