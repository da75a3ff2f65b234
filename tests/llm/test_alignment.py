"""Test items in documents: the alignment against brute force, and the recall of edited copies."""

import numpy as np

from causalith.llm.decontamination import align, batched, contaminated


def brute(a, b):
    """The best local score, cell by cell: a match 1, a replaced, added or left out word -1."""
    score = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (1 if x == y else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
    return score


def test_alignment_is_the_best_of_all():
    rng = np.random.default_rng(3)
    words = lambda n: rng.integers(2, 7, n).astype(np.uint64)
    a = [words(int(n)) for n in rng.integers(0, 25, 60)]
    b = [words(int(n)) for n in rng.integers(0, 40, 60)]
    for got in (align(a, b), batched(a, b), batched(a, b, cells=64)):
        for x, y, best, row, column in zip(a, b, *got, strict=True):
            score = brute(x, y)
            assert best == score.max()
            assert best == 0 or score[row, column] == best


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(11)
    names = np.array([f"term{i}" for i in range(5000)])
    items = [rng.choice(names, int(n)) for n in rng.integers(25, 60, 60)]
    rows, want = [], set()
    for i, item in enumerate(items):
        copy = []
        for w in item:  # a tenth of the words is replaced, left out or followed by another
            edit = rng.random()
            copy += [] if edit < 0.03 else [str(rng.choice(names))] if edit < 0.07 else [w, str(rng.choice(names))] if edit < 0.1 else [w]
        rows.append((i, " ".join([*rng.choice(names, 80), *copy, *rng.choice(names, 80)])))
        want.add((i, 100 + i))
    rows += [(1000 + i, " ".join(rng.choice(names, 250))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(100 + i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, tests).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
