"""The corpus operators against brute force on small tables with nulls, empty texts, ties and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causalith.llm import language_model, near_dedup, repeats
from causalith.llm.decontamination import contaminated
from causalith.llm.hash_arrays import Shard, coded, join_files, keyed, packed, save, unpacked
from causalith.llm.html_text import main_text
from causalith.llm.language_model import discounts, fit, score
from causalith.llm.media import decode_media, store_texts
from causalith.llm.near_dedup import near_duplicates
from causalith.llm.packing import pack
from causalith.llm.quality import rank_quality, train
from causalith.llm.repeats import remove_repeats
from causalith.llm.sharding import hypergeometric, matrix_row, shuffle_into_shards
from causalith.llm.suffix_array import longest_repeats, suffix_array
from causalith.llm.tokens import tokenizer_path
from causalith.llm.url_filter import judge
from causalith.llm.webp import add_green, decode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, node long"
WORDS = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "end.", "A,B"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    base = [prose(rng, int(n)) for n in rng.integers(1, 300, 40)]
    long = prose(rng, 9000)
    near = [" ".join(w if rng.random() > 0.01 else "xx" for w in b.split()) for b in base[:15] for _ in range(3)]
    return [*base, *near, base[0], base[0], base[1].upper(), long, long + " tail", "", "", None, " \n\t ", "one two", "one  two", "one two three four five", base[2] + base[3] + base[2]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, 0.5, 3, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media_round_trip(docs, none, texts):
    got = {r["doc_id"]: r for r in decode_media(store_texts(docs.select("doc_id", "text"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    equal = texts.index(texts[0], 1)
    assert got[0]["media_sha256"] == got[equal]["media_sha256"] and got[0]["feature"] == got[equal]["feature"]
    assert decode_media(store_texts(none.select("doc_id", "text"))).count() == 0


def test_media_transforms():
    rng = np.random.default_rng(1)
    argb = rng.integers(0, 256, (4, 6, 4))
    packed = (argb[..., 0] << 24 | argb[..., 1] << 16 | argb[..., 2] << 8 | argb[..., 3]).astype(np.uint32)
    less = argb.copy()
    less[..., 1] = (argb[..., 1] - argb[..., 2]) % 256
    less[..., 3] = (argb[..., 3] - argb[..., 2]) % 256
    sent = (less[..., 0] << 24 | less[..., 1] << 16 | less[..., 2] << 8 | less[..., 3]).astype(np.uint32)
    assert (np.asarray(add_green(sent)).reshape(4, 6) == packed).all()
    with pytest.raises(Exception):
        decode([b"RIFF"])


def test_url_filter(spark):
    urls = ["http://a.COM/en/1", "https://x.example.com/en/7x", "https://example.com/en/8", "http://net/de/", "http://b.example.net/de/8?q=1", "http://example.net/de/9", "ftp://org/es", "http://x.org/es/#f", "nothing", None, "http://", "http://host?x", "http://notcom/en/"]
    want = [("a.com", "/en/1", "com/en/", "block"), ("x.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("net", "/de/", "net/de/", "allow"), ("b.example.net", "/de/8", "example.net/de/8", "block"), ("example.net", "/de/9", "net/de/", "allow"), ("org", "/es", None, "allow"), ("x.org", "/es/", "org/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("host", "", None, "allow"), ("notcom", "/en/", None, "allow")]
    pages = [(i, u, "", "v") for i, u in enumerate(urls)]
    pages += [(100 + i, f"http://h{i % 7}.test/{'casino' if i % 3 == 0 else 'news'}/{i}?p=x{i % 5}", "", "v") for i in range(300)]
    labels = spark.createDataFrame([(100 + i, 0 if i % 3 == 0 else 1, None) for i in range(240)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in judge(df, labels).collect()}
    assert len(got) == len(pages)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == want
    assert all((got[100 + i]["verdict"] == "block") == (i % 3 == 0) for i in range(300))
    assert all(r["verdict"] == "allow" for r in judge(df.filter("page_id >= 100"), labels.limit(0)).collect())
    assert judge(df.limit(0), labels).count() == 0


def test_packing(docs, none, texts):
    rows = pack(docs, capacity=2048).collect()
    tokenizer = Tokenizer.from_file(str(tokenizer_path()))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r["start"])
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()] and {r["doc_tokens"] for r in own} == {len(ids)}
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in w])
        assert ends[-1] <= 2048 and [r["offset"] for r in w] == [0, *ends[:-1].tolist()]
    total = sum(r["length"] for r in rows)
    assert len(windows) == math.ceil(total / 2048)
    assert pack(none).count() == 0


def test_quality(spark, none):
    rng = np.random.default_rng(3)
    rows = [(i, (prose(rng, 80) + ". ") if i % 2 else "!!! BUY $$$ " * int(rng.integers(3, 30))) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 0.5, 3, 9) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in rank_quality(docs, train(docs, labels)).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == bool(i % 2) for i in range(300, 400)) >= 98
    same = rank_quality(docs, train(docs, labels.limit(0)))
    assert len({r["score"] for r in same.collect()}) == 1
    assert rank_quality(none, train(none, labels)).count() == 0


def brute_components(texts, percent, width=5):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").encode().translate(table).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, none, texts, percent):
    got = {r["doc_id"]: r for r in near_duplicates(docs, percent=percent).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == brute_components(texts, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert near_duplicates(none).count() == 0


def test_near_duplicates_with_far_hub(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = [prose(rng, 200) for _ in range(6)]
    texts = [prose(rng, 300) for _ in range(20)] + [f"{b} {tail}" for b in base for tail in ("one", "two")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # One bucket of all texts: its hub is far from all others but one at most.
    monkeypatch.setattr(near_dedup, "_bands", lambda nodes, m: nodes.select("node", F.lit(1).cast("long").alias("key")))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts, 80)]


def test_sharding(docs, none, texts):
    rows = shuffle_into_shards(docs, shards=8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shuffle_into_shards(none).count() == 0
    counts, columns = np.array([5, 0, 17, 3]), np.array([7, 8, 10])
    matrix = np.array([matrix_row(counts, columns, i, 4) for i in range(4)])
    assert (matrix.sum(1) == counts).all() and (matrix.sum(0) == columns).all() and (matrix >= 0).all()
    rng = np.random.default_rng(5)
    draws = [hypergeometric(rng, 10**10, 10**10, 10**4) for _ in range(200)]
    assert abs(np.mean(draws) - 5000) < 5 * 50 / math.sqrt(200) and 35 < np.std(draws) < 65


def test_decontamination(spark, none):
    rng = np.random.default_rng(9)
    items = [" ".join(f"b{rng.integers(5000)}" for _ in range(n)) for n in (40, 25, 12)]
    edited = items[1].split()
    edited[5], edited[15] = "changed", "words"
    texts = [f"{prose(rng, 50)} {items[0].upper()} {prose(rng, 30)}", f"{prose(rng, 9)} {' '.join(edited)}", items[2], prose(rng, 500), prose(rng, 3000), "", None, items[0].replace(" ", ", ")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 0.5, 3, 9) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None, None, None, None)], SCHEMA)
    benchmark = spark.createDataFrame([(100 + i, t, 1.0) for i, t in enumerate(items)] + [(200, None, 0.0), (201, "", 0.0), (None, items[0], 0.0)], "item_id long, text string, score double")
    found = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, benchmark).collect()}
    assert set(found) == {(0, 100), (1, 101), (2, 102), (7, 100)}
    r = found[0, 100]
    assert texts[0].encode()[r["first_byte"] : r["last_byte"]].decode().lower() == items[0] and r["score"] == 1
    assert contaminated(none, benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_of_parts(spark):
    rng = np.random.default_rng(11)
    items = [[f"c{i}x{rng.integers(10**6)}" for _ in range(n)] for i, n in enumerate((40, 60, 60))]
    fifth = [w if k % 5 else f"new{k}" for k, w in enumerate(items[0])]
    parts = [" ".join(fifth), " ".join(items[1][20:35]), " ".join(items[2])]
    # A fragment in a thousand documents, whose item is in one of them whole.
    parts += [" ".join(items[2][10:25])] * 1000
    docs = spark.createDataFrame([(i, f"{prose(rng, 20)} {t} {prose(rng, 20)}", "en", "s", None, 0.5, 3, 9) for i, t in enumerate(parts)], SCHEMA)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["score"] * len(items[r["item_id"]])) for r in contaminated(docs, benchmark).collect()}
    # Eight words of 40 are replaced, the first one at the edge: 32 matches less 7.
    assert found == {(0, 0): 25, (1, 1): 15, (2, 2): 60} | {(i, 2): 15 for i in range(3, 1003)}


def test_main_text(spark):
    page = "<html><head><title>T</title><script>x<y</script></head><body><nav><ul><li>Home</li></ul></nav>{}<footer>foot</footer></body></html>"
    article = page.format("<article><h1>A &amp; B</h1><p>one\n two <b>three</b></p><div class='comments'>bad</div><p>caf&eacute;</p></article><div>side</div>")
    pages = [(1, "http://h/1", article), (2, None, None), (3, "http://h/3", ""), (4, "x", "plain &lt; text")]
    pages += [(10 + i, f"http://g/{i}", page.format(f"<div>All of our pages say this very same thing here today</div><p>{' '.join(f'p{i}u{j}' for j in range(30))}</p>")) for i in range(4)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in main_text(df).collect()}
    assert got[1]["text"] == "A & B\none two three\ncafé" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain < text"
    assert all(got[10 + i]["text"] == " ".join(f"p{i}u{j}" for j in range(30)) for i in range(4))
    assert main_text(df.limit(0)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    for _ in range(60):
        t = [*rng.integers(1, 1 + int(rng.integers(1, 5)), int(rng.integers(0, 40))).tolist(), 0]  # the end is the least
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    text = [3, 1, 2, 1, 2, 9, 1, 2, 1, 0]
    want = [max((next((k for k in range(99) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]
    assert longest_repeats(text) == want


@pytest.mark.parametrize("most", [1000, 2])
def test_repeats(spark, none, monkeypatch, most):
    monkeypatch.setattr(repeats, "TASK_CONTEXTS", most)  # classes of more than 2 contexts are split
    rng = np.random.default_rng(4)
    passage = [prose(rng, 150) for _ in range(3)]
    texts = [prose(rng, 300), passage[0] + prose(rng, 60), prose(rng, 40) + passage[0] + "é" + passage[1], passage[1][:399], passage[1][:400], prose(rng, 10) + passage[2] + " " + passage[2], "", None, "ab" * 500, "x" * 399, "x" * 400, "y" * 401, "same " * 100, "same " * 100]
    texts += [prose(rng, 30)[-k:] + passage[0][200 : 700 - 9 * k] + prose(rng, 30)[: 5 * k] for k in range(1, 20)]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 400] for r in raw for i in range(len(r) - 399))
    want = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want.append((bytes(np.frombuffer(r, np.uint8)[~gone]), int(np.sum(gone[1:] & ~gone[:-1]) + (gone[:1].any()))))
    docs = spark.createDataFrame([(i, t, "en", "s", None, 0.5, 3, 9) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert [(bytes(got[i]["kept"]), len(got[i]["spans"])) for i in range(len(texts))] == want
    marked = {r["doc_id"]: r for r in remove_repeats(docs, marked=51).select("doc_id", "kept", "n_marked").collect()}
    assert all(bytes(marked[i]["kept"]) == want[i][0] for i in range(len(texts)))
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    assert [marked[i]["n_marked"] for i in range(len(texts))] == [len({j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}) for w in words]
    assert remove_repeats(none).count() == 0


def test_repeats_come_from_the_order(monkeypatch):
    """Without the suffix array's order, repeats are missed."""
    rng = np.random.default_rng(3)
    window = repeats.Window(400)
    shared = rng.integers(0, 256, 500).astype(np.uint8)
    texts = [np.concatenate([rng.integers(0, 256, 90).astype(np.uint8), shared, rng.integers(0, 256, 90).astype(np.uint8)]) for _ in range(12)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    k, _, owner, s, m, b = repeats.contexts(data, offsets, window)
    k, back, n = np.unique(k, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[back] > 1)
    begin = offsets[owner[some]] + s[some]
    parts = [data[x : x + n + 399] for x, n in zip(begin, m[some], strict=True)]
    args = (np.concatenate(parts), np.cumsum([0, *map(len, parts)]), m[some], b[some], window)
    context, place = repeats.repeated_windows(*args)
    found = {(int(owner[some][c]), int(s[some][c] + p)) for c, p in zip(context, place, strict=True)}
    assert found >= {(t, 90 + i) for t in range(12) for i in range(101)}
    monkeypatch.setattr(repeats, "suffix_array", lambda text: rng.permutation(len(text)).tolist())
    assert len(repeats.repeated_windows(*args)[0]) < len(context)


def test_repeats_of_words(spark, none):
    rng = np.random.default_rng(12)
    passage = [[f"{k}{rng.integers(1000)}" for _ in range(n)] for k, n in zip("abcde", (51, 50, 80, 51, 160), strict=True)]
    solid = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 9000, 200))
    around = lambda t: f"{prose(rng, 20)} {t} {prose(rng, 20)}"
    texts = [around(" ".join(p)) for p in passage for _ in range(2)]
    texts += [around("\n ".join(passage[2])), " ".join(passage[3]), around(" ".join(passage[4][30:90])), "", None, "a b " * 60, "a " * 50]
    assert max(len(" ".join(passage[k])) for k in (0, 3)) < 400
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    want = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                gone[i : i + 51] = True
        want.append([x for x, g in zip(w, gone, strict=True) if not g])
    assert sum(map(len, want)) < sum(map(len, words)) - 900 and want[2:4] == words[2:4]
    apart = [around(f"{i}{solid}{i}") for i in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 0.5, 3, 9) for i, t in enumerate(texts + apart)], SCHEMA)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in remove_repeats(docs, words=51).collect()}
    assert [got[i].split() for i in range(len(texts))] == want and got[11] == ""
    # Strings of 400 bytes without blanks go as before.
    assert [got[len(texts) + i] for i in range(2)] == [t.replace(solid, "") for t in apart]
    assert remove_repeats(none, words=51).count() == 0


@pytest.mark.parametrize("hot", [5, 1 << 40])
def test_language_model(docs, none, texts, hot, monkeypatch):
    monkeypatch.setattr(language_model, "RUN", 2000)  # several runs, also of one text
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [["\1", "\1", *(t or "").translate(table).split(), "\0"] for t in texts]
    words_in = [w for i, w in enumerate(words) if i % 3]
    c1 = Counter(x for w in words_in for x in w[2:])
    c3 = Counter(p for w in words_in for p in zip(w, w[1:], w[2:], strict=False))
    c2 = Counter((b, c) for _, b, c in c3)
    behind = Counter(c for _, c in c2)
    d3, d2, d1 = (discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in (c3, c2, behind))
    n, v, kinds = sum(c1.values()), len(c1), sum(behind.values())
    uniform = sum(d1[min(c, 3)] for c in behind.values()) / kinds / (v + 1)
    context = defaultdict(lambda: [0, 0.0])
    for x, d in ((c3, d3), (c2, d2)):
        for (*a, _), c in x.items():
            context[tuple(a)][0] += c
            context[tuple(a)][1] += d[min(c, 3)]

    def p(a, b, c):
        low = (max(behind[c] - d1[min(behind[c], 3)], 0) / kinds if c in behind else 0) + uniform
        for have, d, gram in ((c2, d2, (b, c)), (c3, d3, (a, b, c))):
            total, held = context.get(gram[:-1], (0, 0.0))
            low = (max(have[gram] - d[min(have[gram], 3)], 0) + held * low) / total if total else low
        return low

    got = {r["doc_id"]: r for r in score(docs, fit(docs.filter("doc_id % 3 <> 0"), hot=hot)).collect()}
    for i, w in enumerate(words):
        r, t = got[i], w[2:]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(x in c1 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(*x)) for x in zip(w, w[1:], t, strict=False)))
    for a in (("w1", "w2"), ("\1", "\1"), ("\1", "w3")):
        assert sum(p(*a, b) for b in c1) + p(*a, "?") == pytest.approx(1)
    if hot == 5:
        assert score(none, fit(none)).count() == 0 and score(docs.limit(2), fit(none)).count() == 2


def test_hash_arrays(tmp_path):
    rng = np.random.default_rng(8)
    parts = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (5000, 1, 0, 37)]
    rows = [np.stack([rng.integers(0, 400, len(k)), rng.integers(0, 2, len(k)) * (1 << 40)], 1) for k in parts]
    for i, (k, v) in enumerate(zip(parts, rows, strict=True)):
        for wide in (False, True):
            if len(k):
                save(f"{tmp_path}/{wide}-{i}", {f"q{x}": y for x, y in (keyed(k, wide) | coded(v)).items()})
    for wide in (False, True):
        empty = {f"q{x}": y for x, y in (keyed(parts[2], wide) | coded(rows[2])).items()}
        join_files([f"{tmp_path}/{wide}-{i}" for i in range(4)], f"{tmp_path}/{wide}", empty)
        shard = Shard(f"{tmp_path}/{wide}")
        for i in (3, 0, 1, 2):
            asked = np.concatenate([parts[i], parts[0] ^ np.uint64(1 << 40)])
            place = shard.find("q", asked, np.full(len(asked), i))
            assert place.tolist() == [*range(len(parts[i])), *[-1] * len(parts[0])]
            assert (shard.values("q", place, np.full(len(asked), i))[: len(parts[i])] == rows[i]).all()
    columns = [np.sort(rng.integers(0, 1 << 40, 300)), rng.integers(0, 9, 300), np.full(300, 1 << 62)]
    assert all((a == b).all() for a, b in zip(columns, unpacked(packed(columns)), strict=True))
