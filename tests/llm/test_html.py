"""Text that pages of odd markup hold: nothing of the article is lost, nothing else comes in."""

import numpy as np
import pytest

from causalith.llm import html_text
from causalith.llm.html_text import _text, blocks, main_text

AROUND = "<article><p>one two</p>{}<p>three four</p></article>"
PAGES = {
    "head not ended": ("<html><head><title>T</title><body><article><p>one</p></article>", "one"),
    "head not ended, no body": ("<head><title>T</title><meta charset=x><article><p>one</p></article>", "one"),
    "head not ended, text": ("<head><title>T</title>plain text", "plain text"),
    "form around the page": ("<body><form id=f><nav>menu</nav><article><p>one</p></article></form>", "one"),
    "form around the page, no article": ("<body><form id=f><nav>menu</nav><p>one</p></form>", "one"),
    "form": ("<article><p>one</p><form><p>mail</p><input></form></article>", "one"),
    "form alone": ("<body><p>one</p><form><p>mail</p><input></form>", "one"),
    "button not ended": (AROUND.format("<div><button>Go</div>"), "one two\nthree four"),
    "svg not ended": (AROUND.format("<div><svg><path d=x></div>"), "one two\nthree four"),
    "svg": ("<article><figure><svg><title>t</title><desc>d</desc><text>north</text></svg><figcaption>map</figcaption></figure></article>", "north\nmap"),
    "math": ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"),
    "xmp": ("<article><p>a</p><xmp><b>x</b> &amp; y</xmp><p>b</p></article>", "a\n<b>x</b> &amp; y\nb"),
    "object": ("<article><p>a</p><object data=x><p>in words</p></object></article>", "a\nin words"),
    "noscript": (AROUND.format("<p>x<noscript><p>turn on scripts</p></noscript>y</p>"), "one two\nx y\nthree four"),
    "names in addresses": ('<article><p>see <a href="/q?id=search">the list</a> here</p></article>', "see the list here"),
    "names in data": ('<article><p data-role="social">one</p></article>', "one"),
    "quotes in values": ("<article><p>one <a title='it's'>two</a> three</p><p title=\"a > b\">don't stop</p></article>", "one two three\ndon't stop"),
    "quote not ended": ('<article><p title="x>one</p><p>two</p></article>', "one\ntwo"),
    "subjects": ('<article class="post tag-social has-sidebar"><p>one</p></article>', "one"),
    "layout": ('<div class="no-sidebar"><article><p>one</p></article></div>', "one"),
    "main in a named part": ('<div class="page-with-menu"><ul><li>a</ul><main><p>one</p></main></div>', "one"),
    "advert": ('<article><p>one</p></article><article class="ad"><p>buy</p></article>', "one"),
    "comments": ('<article><p>one</p></article><div id="comments"><article class="comment"><p>nice</p></article></div>', "one"),
    "related": ("<main><p>one</p><aside><article>other</article></aside></main>", "one"),
    "div ends p": ('<article><p class="share">Share<div>real</div><p>more</article>', "real\nmore"),
    "li ends li": ("<article><ul><li class=ad><p>Buy<li>real</ul></article>", "real"),
    "dd ends dt": ("<article><dl><dt>a<dd class=promo>buy<dt>b<dd>c</dl></article>", "a\nb\nc"),
    "cells": ("<article><table><tr><td class=ad>buy<td>real<tr><td>more</table></article>", "real\nmore"),
    "stray end in a cell": ("<div><article><table><tr><td>a</div>b</td></tr></table><p>c</p></article></div>", "a\nb\nc"),
    "part of a line": ('<article><p>one <span class="share">Share <span>this</span> now</span> two <button>Go</button> three</p></article>', "one two three"),
    "split reference": ("<article><p>&<b>amp;</b></p></article>", "&amp;"),
    "comments of markup": ("<article><!--><p>one</p><!-- x --!><p>two</p></ p><!-- y --></article>", "one\ntwo"),
    "cut in a tag": ('<article><p>one</p><p class="x', "one"),
    "slash of a value": ("<article><script src=/a/>code()</script><p>one</p></article>", "one"),
    "select": ("<article><p>pick <select><option>a<option>b</select> now</p></article>", "pick now"),
    "signs": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "none": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_odd_markup(name):
    page, want = PAGES[name]
    assert _text(blocks(page), None) == want


@pytest.mark.parametrize("page", ["<p " + 'a="b" ' * 5000, "<p a=" + " =" * 5000, "<div>" * 3000 + "x", "<" * 5000, "<p a='" * 2000])
def test_no_markup_takes_long(page):
    blocks(page)


def test_copies_of_a_page_keep_their_text(spark):
    own = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcde"]
    menu = "<div>one two three four five six seven</div>"
    rows = [(i, f"http://h/{i}", f"<head><title>{i}</title><body>{menu}<p>{own[i % 5]}</p>") for i in range(8)]
    rows += [(10 + i, f"http://{i}/x", f"{menu}<p>{own[0]}</p>") for i in range(2)]  # the same on other hosts
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own[i % 5] for i in range(8)} | {10 + i: f"one two three four five six seven\n{own[0]}" for i in range(2)}


def test_a_block_keeps_its_own_runs(spark):
    notice = "please note that our offices are closed on all of these public holidays and days before them"
    own = ["the town hall opens at nine", "we meet again in late may"]
    rows = [(i, f"http://h/{i}", f"<div>{notice} {o}</div><p>{i} is the number</p>") for i, o in enumerate(own)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{o}\n{i} is the number" for i, o in enumerate(own)}


@pytest.mark.parametrize("pages", [400, 2])
def test_a_run_of_three_pages_whatever_their_groups(spark, monkeypatch, pages):
    monkeypatch.setattr(html_text, "GROUP_PAGES", pages)  # of some notices two pages meet in one group, and the third is in another
    rng = np.random.default_rng(5)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 30)) for _ in range(24)]
    notes = {i: [] for i in range(24)}
    for k in range(24):
        for i in rng.choice(24, 3, replace=False):
            notes[int(i)].append("<div>" + " ".join(f"n{k}x{j}" for j in range(8)) + "</div>")
    rows = [(i, f"http://h/{i}", f"<p>{t}</p>{''.join(notes[i])}") for i, t in enumerate(own)]
    rows += [(50 + i, f"http://h/{50 + i}", f"<nav>other menu {i} of this page only</nav><p>{own[i]}</p>{''.join(notes[i])}") for i in range(4)]  # one text, other menus
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(own)) | {50 + i: own[i] for i in range(4)}


def test_a_group_of_few_words():
    """A lone page may have fewer tokens than a run."""
    for tokens in ([], ["a"], ["a", "b"]):
        assert [len(x) for x in html_text.repeated_starts([tokens], [0])[0]] == [0, 0, 0, 0]
