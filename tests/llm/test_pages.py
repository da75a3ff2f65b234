"""Page operators: mined rules against brute force, and boilerplate that only a whole host shows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalith.llm import html_text, url_filter
from causalith.llm.html_text import main_text
from causalith.llm.url_filter import judge, mine


def baskets(n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        tokens = sorted(set(rng.choice(list("abcdefgh"), 4)))
        rows.append((tokens, bool(rng.random() < (0.7 if {"a", "b"} <= set(tokens) else 0.5 if "c" in tokens else 0.1))))
    return [*rows, (["a"], None), (None, True), ([], True)]


def test_rules_by_brute_force(spark):
    rows = baskets()
    known = [(set(t), b) for t, b in rows if t is not None and b is not None and (t or b)]
    n, base = len(known), sum(b for _, b in known) / len(known)
    rules = {}
    for size in range(1, 5):
        for tokens in combinations("abcdefgh", size):
            holding = [b for t, b in known if set(tokens) <= t]
            k, m = sum(holding), len(holding)
            if m and k >= 5 and k / n >= 0.002 and k / m >= 1.5 * base:
                c, z = k / m, 2.33
                if (c + z * z / (2 * m) - z * (c * (1 - c) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m) > base:
                    rules[tokens] = c
    want = {t: c for t, c in rules.items() if not any(set(o) < set(t) and rules[o] >= c for o in rules)}
    got = {tuple(r["tokens"]): r["confidence"] for r in mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), lift=1.5).collect()}
    assert got == pytest.approx(want) and ("a", "b") in got


def test_rules_decide_pages_and_hold_on_others(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pages, bad = [], {}
    for i in range(1500):
        host, path = rng.choice(["win", "shop", "news", "blog"]), rng.choice(["play", "read", "buy"])
        bad[i] = bool(rng.random() < (0.9 if (host, path) == ("win", "play") else 0.05))
        pages.append((i, f"http://{host}.test/{path}/{i}?ref={rng.choice(['x', 'y'])}"))
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in bad.items() if i % 3], "doc_id long, quality int")
    held = [r for r in judge(df, labels, confidence=0.5).collect() if r["page_id"] % 3 == 0]
    blocked = [bad[r["page_id"]] for r in held if r["verdict"] == "block"]
    assert len(blocked) > 20 and np.mean(blocked) > 0.8  # precision on pages without a label
    monkeypatch.setattr(url_filter, "mine", lambda *a, **k: mine(labels.limit(0).select(F.array().cast("array<string>").alias("tokens"), F.lit(True).alias("bad"))))
    assert all(r["verdict"] == "allow" for r in judge(df, labels, confidence=0.5).collect())


def lone_pages(n):
    """Pages without an article; a notice is on two of them only, a menu on all."""
    rng = np.random.default_rng(2)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 100_000, 30))
    own = [prose() for _ in range(n)]
    notice = "please note that our offices are closed on all of these public holidays"
    parts = [f"<div>one two three four five six seven</div><p>{t}</p>" + (f"<div>{notice}</div>" if i in (1, n - 1) else "") for i, t in enumerate(own)]
    return [(i, f"http://h/{i}", f"<html><body>{p}</body></html>") for i, p in enumerate(parts)], own


@pytest.mark.parametrize("pages", [400, 2])
def test_runs_of_a_whole_host(spark, monkeypatch, pages):
    monkeypatch.setattr(html_text, "GROUP_PAGES", pages)  # in one group or in many, the result is the same
    rows, own = lone_pages(23)
    df = spark.createDataFrame([*rows, rows[4], (None, None, "<p>alone here</p>"), (99, "http://h/a", f"<article>{own[0]}</article>")], "page_id long, url string, html string")
    got = main_text(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in got if r["page_id"] is not None and r["page_id"] < 50) == sorted([*enumerate(own), (4, own[4])])
    assert {r["text"] for r in got if r["page_id"] in (None, 99)} == {"alone here", own[0]}


def test_runs_need_the_suffix_array(spark, monkeypatch):
    rows, own = lone_pages(6)
    assert [len(x[0]) > 0 for x in html_text.repeated_starts([html_text._stream(["a b c d e f"]), html_text._stream(["x", "a b c d e f"])], [0, 0])] == [True, True]
    monkeypatch.setattr(html_text, "longest_repeats", lambda text, owner: [0] * len(text))
    assert all(len(x[0]) == 0 for x in html_text.repeated_starts([["a"] * 9, ["a"] * 9], [0, 0]))


def articles(n, copies=0):
    """Articles of a host with a notice in most and a licence line in some, then copies of the first with the notice alone around them."""
    rng = np.random.default_rng(3)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 100_000, 30))
    own = [[prose(), prose()] for _ in range(n)]
    notice, licence = "sign up here for all of our weekly letters", "some rights are reserved under licence four of that kind"
    parts = [[a, notice, b] if i % 4 else [a, licence, b] for i, (a, b) in enumerate(own)]
    want = [own[i] if i % 4 else parts[i] for i in range(n)]
    parts, want = parts + [parts[0]] * copies, want + [want[0]] * copies
    return [(i, f"http://h/{i}", "<article>" + "".join(f"<p>{t}</p>" for t in p) + "</article>") for i, p in enumerate(parts)], {i: "\n".join(w) for i, w in enumerate(want)}


@pytest.mark.parametrize("pages", [400, 3])
def test_runs_of_most_articles(spark, monkeypatch, pages):
    monkeypatch.setattr(html_text, "GROUP_PAGES", pages)
    rows, want = articles(24, copies=30)
    few = [(100 + i, f"http://few/{i}", h) for i, _, h in rows[:8]]  # eight articles of a host show nothing
    same = [(200 + i, f"http://same/{i}", f"<article><p>w{i}</p><p>{' '.join('abcdefghijklmnopqrst')}</p></article>") for i in range(15)]  # near copies
    df = spark.createDataFrame(rows + few + same, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert {i: t for i, t in got.items() if i < 100} == want
    assert all("letters" in got[100 + i] for i in range(8) if i % 4)
    assert all(got[200 + i] == f"w{i}\n{' '.join('abcdefghijklmnopqrst')}" for i in range(15))


def test_common_runs_are_counted_by_the_suffix_array(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(30):
        streams = [" ".join(rng.choice(list("abc"), int(rng.integers(0, 25)))) + " e" for _ in range(int(rng.integers(1, 7)))]
        held = {}
        for t in streams:
            words = t.split()
            for run in {tuple(words[i : i + 5]) for i in range(len(words) - 4)}:
                held[run] = held.get(run, 0) + 1
        runs, counts = html_text.common_runs(streams)
        want = {int(html_text._windows([" ".join(r)])[3][0]): k for r, k in held.items() if 2 * k > len(streams)}
        assert dict(zip(runs.tolist(), counts.tolist(), strict=True)) == want
    monkeypatch.setattr(html_text, "owners_of_runs", lambda text, owner, length: [0] * len(text))
    assert not len(html_text.common_runs(["a b c d e f"] * 4)[0])
