"""Main text of web pages: blocks of the page, and boilerplate that a host repeats.

A page is cut into blocks in page order. Blocks inside an article (or main) element are its text, but for parts that their
elements name as something else: menus, headers, footers, sidebars, notices, adverts, forms, comments. The blocks outside
articles form one token stream of the page, those inside another. The streams of a host's pages are concatenated, and suffix
arrays over them (linear grouping) find long runs of tokens that start in several pages; blocks that such runs cover are
boilerplate, but for the runs of their own that they hold. A page without an article keeps what is neither named as something else
nor covered by runs of two pages; pages of one text are one page. In articles passages and licence lines are shared by some and are
part of them; runs count that more than half of the host's distinct articles hold, ``LEAST_ARTICLES`` at least, and that cover the
lesser part of the article: else it is a copy, and stays whole.

A host's pages meet in bounded groups dealt by hash, each with a suffix array of its own. A run's windows that are not repeated in
their group are exchanged by hash between all groups of the host, and those that two groups hold, or one group and a run repeated in
another, are repeated as well: what is found does not depend on the groups. A run that half of a host's articles hold is held by half of those of one group; such runs
are counted again over the whole host.
"""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, slices, table, text_buffer, word_hashes
from .suffix_array import longest_repeats, owners_of_runs

#: Tokens of a repeated run, the share of a block that must be covered, pages of a host in one group, pages in a task.
RUN, SHARE, GROUP_PAGES, TASK_PAGES = 5, 0.6, 400, 1600
#: Distinct articles of a host that hold a run before it counts as the host's.
LEAST_ARTICLES = 10

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; they end at their own end tag, or with the page.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Menus, headers, footers, sidebars and forms, and what a browser with scripts does not show.
_OTHER = frozenset("nav header footer aside form menu dialog head fieldset search button select datalist noscript template annotation annotation-xml desc metadata defs symbol".split())
_MAIN = frozenset("article main".split())
#: A form that holds any of these is around the page: it is no part of it.
_PARTS = frozenset("nav header footer aside article main".split())
#: Words of class, id and role that name other parts of a page.
_NAMED = re.compile(
    r"(?:^|[_-])(?:ads?|advert(?:s|isement|ising|isements)?|adsense|adbox|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|navigation|nav|navbar|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|side-bar|aside|complementary|contentinfo"
    r"|notices?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|reply|respond|search|pagination|pager|widget|skip-link)(?:$|[_-])",
    re.I,
)
#: Words of a layout, and of an article's subjects, say nothing of what an element is.
_LAYOUT = re.compile(r"(?:has|have|no|not|with|without|hide|show)[_-]", re.I)
_SUBJECT = re.compile(r"(?:tag|category|cat|topic|has|have|no|not|with|without|hide|show)[_-]", re.I)
#: A quote opens a value only after an equals sign; one that is never closed is a character like others.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s]*)))?""")
#: Start tags that may stand in a head; any other, and any text, ends it.
_HEAD = frozenset("head base link meta title noscript noframes style script template".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing dd dt main menu nav ol pre search section table ul xmp".split())
_CLOSED = frozenset("button object template noscript svg math".split())
#: Start tags that end an open element of these names, sought up to an element of those.
_ENDS = {
    "p": (frozenset(["p"]), _BLOCK | _CLOSED),
    "li": (frozenset(["li"]), _BLOCK - {"p", "div", "address"} | _CLOSED),
    "dd": (frozenset(["dd", "dt"]), _BLOCK - {"p", "div", "address"} | _CLOSED),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_ENDS |= {"dt": _ENDS["dd"], "th": _ENDS["td"], "thead": _ENDS["tbody"], "tfoot": _ENDS["tbody"]}
#: End tags of other names do not reach out of these.
_SCOPE = frozenset("table caption td th object template".split())
_TABLE = frozenset("table caption tbody thead tfoot tr td th object template html body".split())


@lru_cache(4096)
def _short_named(attributes: str, main: bool) -> bool:
    return _named(attributes, main)


def _named(attributes: str, main: bool) -> bool:
    """Whether class, id or role name another part of the page."""
    for name, *value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role") and any(_NAMED.search(w) and not (_SUBJECT if main else _LAYOUT).match(w) for w in "".join(value).split()):
            return True
    return False


def _sought(stack: list, wanted, until) -> int | None:
    """The place of the innermost open element of the wanted names, up to one of those in ``until``."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in wanted:
            return i
        if stack[i][0] in until:
            return None
    return None


def blocks(page: str) -> list[tuple[str, str]]:
    """The page's blocks of text in order: ``main``, ``other`` or ``open`` (outside articles, not named), and the text.

    Elements nest and end as HTML says, with end tags left out or not. Another part inside a line leaves the line whole; a ``main``
    element is the text even where its surroundings' class names something else.
    """
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, list | None]] = []  # open elements that matter, the kind inside, and the line that one interrupts
    held: dict[str, int] = {}  # how many of them have each name
    kind, at, n = "open", 0, len(page)
    forms, around = 0, set()  # kinds of forms, and of those around the page

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((kind, text))
            parts.clear()

    def add(text):
        if stack and stack[-1][0] == "head" and text.strip():
            leave(len(stack) - 1)
        parts.append(html.unescape(text) if "&" in text else text)

    def leave(i):
        nonlocal kind, parts
        while len(stack) > i:
            name, inside, line = stack[-1]
            before = stack[-2][1] if len(stack) > 1 else "open"
            if name in _BLOCK or inside != before:
                flush()
            stack.pop()
            held[name] -= 1
            kind = before
            if line is not None:
                parts = [*line, " "]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK:
                flush()
            if held.get(name) and (i := _sought(stack, (name,), _SCOPE if name not in _TABLE else ("table",))) is not None:
                leave(i)
            continue
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            leave(len(stack) - 1)
        # A slash that ends a value without quotes closes nothing.
        closed = m[3].endswith("/") and not any(value.endswith("/") for *_, value in _ATTRIBUTE.findall(m[3])[-1:])
        if name in _RAW:
            if name == "xmp":
                if held.get("p") and (i := _sought(stack, *_ENDS["p"])) is not None:
                    leave(i)
                flush()
            if not closed:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if name == "xmp":
                    parts.append(page[at : end.start() if end else n])
                    flush()
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if held.get("p") and name in _ENDS_P and (i := _sought(stack, *_ENDS["p"])) is not None:
            leave(i)
        if name in _ENDS and any(held.get(e) for e in _ENDS[name][0]) and (i := _sought(stack, *_ENDS[name])) is not None:
            leave(i)
        block = name in _BLOCK
        if block:
            flush()
        if name in _VOID or closed and not block:
            continue
        form = forms and kind.startswith("form")
        if form and name in _PARTS:
            around.add(kind)
        free = form or kind == "open"
        if name in _OTHER and not (name == "form" and free):
            inside = "other"
        elif kind != "other" and m[3] and "=" in m[3] and name not in ("html", "body") and (_short_named if len(m[3]) < 200 else _named)(m[3], name in _MAIN):
            inside = "named"
        elif name == "form" and kind == "open":
            forms += 1
            inside = f"form{forms}"
        elif name == "main" and kind == "named" or name in _MAIN and (free or kind == "main"):
            inside = "main"
        else:
            inside = kind
        if block or inside != kind or name in _SCOPE or kind in ("other", "named"):
            line = None
            if inside != kind and not block:
                line, parts = parts, []
            stack.append((name, inside, line))
            held[name] = held.get(name, 0) + 1
            kind = inside
    leave(0)
    flush()
    return [("open" if k in around else k if k in ("main", "open") else "other", t) for k, t in out]


_HOST = r"://([^/?#]*)"


def _host(column: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(column), _HOST, 1), F.lit("")))


def _name(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _row() -> F.Column:
    """Names a page: rows equal in page_id, url and html are one page here."""
    return F.xxhash64("page_id", "url", "html")


def _streams(pages: DataFrame) -> DataFrame:
    """``row``, ``host``, ``outside`` (blocks outside articles), ``lone`` (whether the page has no article), ``same`` and ``owner``.

    ``same`` is a hash of these; ``owner`` too, but of the blocks that can be text where the page has no article.
    """

    def parse(batches):
        for batch in slices(batches, "html"):
            outside, lone, same, owner = [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = blocks(page or "")
                outside.append([t for k, t in found if k != "main"])
                lone.append(all(k != "main" for k, _ in found))
                same.append(_name("\0".join([host, str(lone[-1]), *outside[-1]])))
                owner.append(_name("\0".join([host, *(t for k, t in found if k == "open")])) if lone[-1] else same[-1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(outside, pa.list_(pa.string())), pa.array(lone), pa.array(same, pa.int64()), pa.array(owner, pa.int64())], ["row", "host", "outside", "lone", "same", "owner"])

    return pages.select(_row().alias("row"), _host().alias("host"), "html").mapInArrow(parse, "row long, host string, outside array<string>, lone boolean, same long, owner long")


def _stream(texts: list[str]) -> list[str]:
    """The tokens of blocks; a block's end is a token too, so runs of short menu items are long."""
    return [t for b in texts for t in (*b.split(), "\n")]


def repeated_starts(streams: list[list[str]], groups: list[int], owners: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each page where runs of ``RUN`` tokens begin that also begin in a page of its group with another owner, and where others do.

    Then the hashes of the latter and of the former. Without ``owners`` each page is its own.
    """
    words: list[str] = []
    owner: list[int] = []
    begin = []
    for i, tokens in enumerate(streams):
        begin.append(len(words))
        words += tokens
        words.append(f"\0{i}")
        owner += [i if owners is None else owners[i]] * (len(tokens) + 1)
    if not words:
        return []
    group = np.repeat(np.array(groups, np.int64), [len(tokens) + 1 for tokens in streams])
    names: dict[str, int] = {}
    code = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    prints = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in names], np.uint64)[code]
    # Tokens of different groups are different; each page ends with a mark of its own, the last the least.
    _, code = np.unique(group * len(names) + code, return_inverse=True)
    ends = np.flatnonzero([w[0] == "\0" for w in words])
    code = code + len(ends)
    code[ends] = len(ends) - 1 - np.arange(len(ends))
    longest = np.array(longest_repeats(code.tolist(), owner))
    h = np.zeros(len(words), np.uint64)
    for k in range(RUN):
        h = mix64(h ^ np.append(prints[k:], np.zeros(k, np.uint64))[: len(words)], 61)
    out = []
    for a, z in zip(begin, ends.tolist(), strict=True):
        at = np.arange(max(0, z - a - RUN + 1))
        again = longest[a + at] >= RUN
        out.append((at[again], at[~again], h[a + at[~again]], h[a + at[again]]))
    return out


def _boilerplate(streams: DataFrame) -> DataFrame:
    """``row`` and ``starts`` (places of the page's stream where repeated runs begin) for pages without an article.

    Pages of a host with the same text are one: they do not make each other's text boilerplate.
    """
    rows = streams.filter("lone").select("row", "same").distinct()
    streams = streams.groupBy("same", "host").agg(*(F.first(c).alias(c) for c in ("owner", "outside", "lone")))
    sizes = streams.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("lone").alias("any")).filter("any").select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("groups"), "n")
    sizes = materialize(sizes, "hosts")
    tasks = max(1, int((sizes.agg(F.sum("n")).first()[0] or 0) // TASK_PAGES))
    unit = F.xxhash64("host", F.pmod(F.xxhash64("same"), F.col("groups")))
    dealt = streams.join(sizes, "host").select("same", "owner", "host", "outside", "lone", unit.alias("unit"), (F.col("groups") > 1).alias("many"))

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("unit", "ascending"), ("same", "ascending")])
        _, group = np.unique(np.asarray(rows.column("unit")), return_inverse=True)
        _, owner = np.unique(np.asarray(rows.column("owner")), return_inverse=True)
        # One group, or small ones of about its size, at a time.
        cuts, edges = [0], [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, z in zip(edges, edges[1:], strict=False):
            if z - cuts[-1] > GROUP_PAGES:
                cuts.append(a)
        found = []
        for a, z in zip(cuts, [*cuts[1:], len(group)], strict=True):
            found += repeated_starts([_stream(b) for b in rows.column("outside").slice(a, z - a).to_pylist()], group[a:z].tolist(), owner[a:z].tolist())
        many = rows.column("many").to_pylist()
        none = np.zeros(0, np.int64)
        at, w = ([x[k].astype(np.int64) if m else none for x, m in zip(found, many, strict=True)] for k in (1, 2))
        ends = np.cumsum([0, *(len(x) for x in at)])
        fresh = pa.StructArray.from_arrays([pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(w))], ["i", "w"])
        # What is repeated in a group, once for the group, with the first page that has it.
        known, last, seen = [], -1, set()
        for (_, _, _, h), g, m in zip(found, group.tolist(), many, strict=True):
            seen = seen if g == last else set()
            known.append(sorted(set(h.view(np.int64).tolist()) - seen) if m else [])
            seen.update(known[-1])
            last = g
        columns = {c: rows.column(c) for c in ("same", "owner", "host", "lone")}
        return pa.table(columns | {"starts": pa.array([x[0] for x in found], pa.list_(pa.int32())), "fresh": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), fresh), "known": pa.array(known, pa.list_(pa.int64()))})

    schema = "same long, owner long, host string, lone boolean, starts array<int>, fresh array<struct<i: int, w: long>>, known array<long>"
    found = materialize(dealt.groupBy(F.pmod("unit", F.lit(tasks))).applyInArrow(find, schema), "runs")
    # The suffix array has the windows that are repeated in a group. Those of several groups, or of one and repeated in another, repeat too.
    windows = found.select("same", "owner", "host", "lone", F.inline("fresh"))
    holders = windows.select("host", "w", "owner").distinct().select("host", "w", F.lit(1).alias("n"))
    holders = holders.unionByName(found.select("host", F.explode("known").alias("w"), F.lit(2).alias("n")))
    shared = holders.groupBy("host", "w").agg(F.sum("n").alias("n")).filter("n > 1").select("host", "w")
    across = windows.filter("lone").join(shared, ["host", "w"]).groupBy("same").agg(F.collect_list("i").alias("more"))
    lone = found.filter("lone").select("same", "starts").join(across, "same", "left")
    return rows.join(lone, "same").select("row", F.concat("starts", F.coalesce("more", F.array().cast("array<int>"))).alias("starts"))


#: A block's end in an article's stream: white space to ``blocks``, so no token of theirs, and a word to ``word_hashes``.
_END = " \x1e "


def _windows(streams: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the streams as hashes and the stream of each; where runs of ``RUN`` tokens begin, and the runs' hashes."""
    code, owner, _, _ = word_hashes(*text_buffer(pa.array(streams, pa.string())), lower=False)
    n = max(0, len(code) - RUN + 1)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = mix64(h ^ code[k : k + n], 61)
    at = np.flatnonzero(owner[:n] == owner[RUN - 1 : RUN - 1 + n])
    return code, owner, at, h[at].view(np.int64)


def common_runs(streams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``RUN`` tokens that more than half of the streams hold, as hashes, and how many streams hold each.

    The suffix array is over stretches of runs whose hashes occur in two streams; what lies between is one mark.
    """
    code, owner, at, h = _windows(streams)
    _, which = np.unique(h, return_inverse=True)
    pairs = np.unique(np.stack([which, owner[at]]), axis=1)[0]
    again = at[np.bincount(pairs)[which] >= min(2, len(streams))] if len(at) else at
    inside = np.zeros(len(code) + 1, np.int64)
    np.add.at(inside, again, 1)
    np.add.at(inside, again + RUN, -1)
    inside = np.cumsum(inside[:-1]) > 0
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Stretches of one stream and of the next may touch; a mark of its own ends each.
    kept = np.flatnonzero(inside)
    last = np.append((np.diff(kept) > 1) | (np.diff(owner[kept]) != 0), True)
    ends = np.flatnonzero(last)
    place = np.arange(len(kept)) + np.cumsum(last) - last
    text = np.empty(len(kept) + len(ends), np.int64)
    text[place] = np.unique(code[kept], return_inverse=True)[1] + len(ends)
    text[place[ends] + 1] = len(ends) - 1 - np.arange(len(ends))
    of = np.empty(len(text), np.int64)
    of[place] = owner[kept]
    of[place[ends] + 1] = owner[kept[ends]]
    held = np.array(owners_of_runs(text.tolist(), of.tolist(), RUN))[place[np.searchsorted(kept, again)]]
    many = 2 * held > len(streams)
    runs, first = np.unique(h[np.searchsorted(at, again[many])], return_index=True)
    return runs, held[many][first]


def _articles(pages: DataFrame) -> DataFrame:
    """``host``, ``article`` (a hash), ``text`` (the article's stream) and further columns; copies of an article in a task once."""
    more = [f for f in pages.schema.fields if f.name not in ("page_id", "url", "html")]

    def parse(batches):
        seen: set[tuple] = set()
        for batch in slices(batches, "html"):
            rows, names, texts = [], [], []
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                text = "".join(t + _END for k, t in blocks(page or "") if k == "main")
                name = _name(text)
                if text and (host, name) not in seen:
                    seen.add((host, name))
                    rows.append(i)
                    names.append(name)
                    texts.append(text)
            own = batch.select([f.name for f in more]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.int64()), pa.array(texts, pa.string())], [*own.schema.names, "article", "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in more)
    return pages.mapInArrow(parse, f"{kinds}, article long, text string")


def _common(pages: DataFrame) -> DataFrame:
    """``host`` and ``common``: hashes of the runs that more than half of the host's distinct articles hold."""
    pages = pages.withColumn("host", _host())
    tasks = max(1, pages.count() // TASK_PAGES)
    # Few rows in a file of known size: the pages themselves are not shuffled by host.
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_PAGES)
    sizes = materialize(sizes.select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("groups")), "hosts")
    dealt = _articles(pages.join(sizes, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1).cast("long"))))
    dealt = dealt.withColumn("unit", F.xxhash64("host", F.pmod("article", F.col("groups"))))

    def find(rows: pa.Table) -> pa.Table:
        units, names = np.asarray(rows.column("unit")), np.asarray(rows.column("article"))
        order = np.lexsort((names, units))
        # Copies of an article from several tasks count once.
        fresh = np.concatenate([[True], (np.diff(units[order]) != 0) | (np.diff(names[order]) != 0)])
        out: dict[str, list] = {"host": [], "many": [], "n": [], "run": [], "held": []}
        order = order[fresh]
        for mine in np.split(order, np.flatnonzero(np.diff(units[order])) + 1):
            host, many = rows.column("host")[int(mine[0])].as_py(), rows.column("groups")[int(mine[0])].as_py() > 1
            runs, held = common_runs(rows.column("text").take(pa.array(mine)).to_pylist()) if many or len(mine) >= LEAST_ARTICLES else ([], [])
            found = [(None, None), *zip(runs, held, strict=True)]  # a row for the group, and one for each run
            for k, v in (("host", host), ("many", many), ("n", len(mine))):
                out[k] += [v] * len(found)
            out["run"] += [None if r is None else int(r) for r, _ in found]
            out["held"] += [None if k is None else int(k) for _, k in found]
        return pa.table({"host": pa.array(out["host"], pa.string()), "many": pa.array(out["many"], pa.bool_()), **{k: pa.array(out[k], pa.int64()) for k in ("n", "run", "held")}})

    found = materialize(dealt.groupBy(F.pmod("unit", F.lit(tasks))).applyInArrow(find, "host string, many boolean, n long, run long, held long"), "runs")
    held = found.filter("not many and run is not null").select("host", "run", "held")
    wanted = materialize(found.filter("many and run is not null").groupBy("host").agg(F.collect_set("run").alias("wanted")), "wanted")
    if not wanted.isEmpty():

        def count(batches):
            for batch in batches:
                code = [np.intersect1d(_windows([t])[3], np.array(w, np.int64)) for t, w in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)]
                rows = pa.array(np.repeat(np.arange(len(code)), [len(c) for c in code]), pa.int64())
                own = batch.select(["host", "article"]).take(rows)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *code]))], ["host", "article", "run"])

        holding = _articles(pages.join(wanted, "host")).mapInArrow(count, "host string, article long, run long").distinct()
        held = held.unionByName(holding.groupBy("host", "run").agg(F.count(F.lit(1)).alias("held")))
    articles = found.filter("run is null").groupBy("host").agg(F.sum("n").alias("n"))
    most = held.join(articles, "host").filter((F.col("held") >= LEAST_ARTICLES) & (2 * F.col("held") > F.col("n")))
    return most.groupBy("host").agg(F.collect_list("run").alias("common"))


def _own(texts: list[str], starts) -> list[str | None]:
    """What runs that begin at ``starts`` leave of each block that they cover to ``SHARE``: its own runs of ``RUN`` tokens or more; None: all of it."""
    words = [t.split() for t in texts]
    ends = np.cumsum([0, *(len(w) + 1 for w in words)])
    hit = np.zeros(ends[-1] + 1, np.int64)
    for i in set(starts):
        hit[i] += 1
        hit[min(i + RUN, ends[-1])] -= 1
    covered = np.cumsum(hit[:-1]) > 0
    out: list[str | None] = []
    for a, z, w in zip(ends, ends[1:], words, strict=False):
        if covered[a:z].sum() < SHARE * (z - a):
            out.append(None)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], covered[a : z - 1], [True]])))
        out.append(" ".join(t for i, j in edges.reshape(-1, 2) if j - i >= RUN for t in w[i:j]))
    return out


def _text(found: list[tuple[str, str]], starts: list | None, common: list | None = None) -> str:
    main = [t for k, t in found if k == "main"]
    if not main:
        own = _own([t for _, t in found], starts or [])
        return "\n".join(t if o is None else o for (k, t), o in zip(found, own, strict=True) if k == "open" and o != "")
    if common:
        _, _, at, h = _windows(["".join(t + _END for t in main)])
        own = _own(main, at[np.isin(h, np.array(common, np.int64))].tolist())
        sizes = [len(t.split()) + 1 for t in main]
        if 2 * sum(n for n, o in zip(sizes, own, strict=True) if o is not None) < sum(sizes):
            main = [t if o is None else o for t, o in zip(main, own, strict=True) if o != ""]
    return "\n".join(main)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page (``page_id``, ``url``, ``html``).

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by a line feed. Null
    and empty pages have an empty text; a null url is a host of its own; rows that are equal have the same text and are one page
    when runs are sought. Other columns are left aside.
    """

    def read(batches):
        for batch in slices(batches, "html"):
            starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * batch.num_rows
            common = batch.column("common").to_pylist() if "common" in batch.schema.names else [None] * batch.num_rows
            found = [blocks(p or "") for p in batch.column("html").to_pylist()]
            texts = [_text(b, s, c) for b, s, c in zip(found, starts, common, strict=True)]
            lone = [all(k != "main" for k, _ in b) for b in found]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(lone)], ["page_id", "url", "text", "n_chars", "lone"])

    schema = "page_id long, url string, text string, n_chars long, lone boolean"
    pages = pages.select("page_id", "url", "html")
    found = materialize(_boilerplate(materialize(_streams(pages), "streams")), "boilerplate")
    common = materialize(_common(pages), "common")
    known = pages if common.isEmpty() else pages.withColumn("host", _host()).join(common, "host", "left")
    out = known.mapInArrow(read, schema)
    if found.isEmpty():
        return out.drop("lone")
    lone = pages.withColumn("row", _row()).join(found, "row").mapInArrow(read, schema)
    return out.filter("not lone").unionByName(lone).drop("lone")


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
