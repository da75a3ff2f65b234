"""Near-duplicate classes of documents by SetSketch registers, banding, estimation and exact confirmation.

1. Every text becomes its set of word shingles, a fingerprint, and SetSketch registers. Equal sets are one node from
   here on, however many copies there are.
2. Bands of registers are keys. Each bucket of a key has a random hub; its members are paired with the hub alone, the
   similarity of these pairs is estimated from their registers by maximum likelihood, and pairs far below the
   threshold go. What remains joins nodes to candidate clusters. Members that their hub does not settle (it is far from
   them, or so far that a near copy of theirs may be farther) meet again under longer keys with new hubs, until none
   is left: two sets over the threshold share buckets, and so a hub close to both.
3. Clusters are dealt to tasks: small ones many to a task, large ones in pairs of bounded blocks. A task counts, for
   one set after the other, the exact intersections with all sets of its blocks over an inverted index of shingles,
   and emits one edge for each set that it links to an earlier one, never pairs.
4. Components of those edges are the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix64, release, slices, table, text_buffer
from .components import components
from .sketch import BAND, band_keys, bands_for, fingerprints, likelihood_similarity, registers, shingle_sets

#: Hub pairs estimated below this are not candidates. The estimate's deviation is about 0.04.
LEAST_ESTIMATE = 0.45
#: Keys that an unsettled member gets in the next turn, and registers by which each of them is longer.
SALTS, MORE = 4, 3
#: Documents of a cluster that meet in one block, and bytes of text that a task should get.
BLOCK, TASK_BYTES = 600, 4 << 20


def sketches(docs: DataFrame, width: int, m: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, the set's fingerprint ``f0``, ``f1``, and its registers (null for an empty set)."""

    def sketch(batches):
        for batch in slices(batches, "text", 2 << 20):
            data, offsets = text_buffer(batch.column("text"))
            sets, bounds = shingle_sets(data, offsets, width)
            n = np.diff(bounds)
            prints = fingerprints(sets, bounds).view(np.int64)
            rows = registers(sets, bounds, m)
            raw = [r.tobytes() if k else None for r, k in zip(rows, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "f0", "f1", "registers"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, f0 long, f1 long, registers binary")


def _bands(nodes: DataFrame, m: int) -> DataFrame:
    def keys(batches):
        for batch in batches:
            raw, _ = text_buffer(batch.column("registers"))
            k = band_keys(raw.view(np.uint16).reshape(-1, m)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "keys"])

    return nodes.select("node", "registers").mapInArrow(keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _estimated(pairs: DataFrame, nodes: DataFrame, m: int) -> DataFrame:
    def side(end):
        return nodes.select(F.col("node").alias(end), F.col("registers").alias(f"r{end}"), F.col("n_shingles").alias(f"n{end}"))

    def estimate(batches):
        for batch in batches:
            ra, rb = (text_buffer(batch.column(c))[0].view(np.uint16).reshape(-1, m) for c in ("ra", "rb"))
            na, nb = (np.asarray(batch.column(c), np.float64) for c in ("na", "nb"))
            s = likelihood_similarity(ra, rb, na, nb) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.asarray(s, np.float64))], ["a", "b", "similarity"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(estimate, "a long, b long, similarity double")


def _longer(rest: DataFrame, nodes: DataFrame, m: int, turn: int) -> DataFrame:
    """Members of buckets (``node``, ``key``, ``out``) under keys that ``MORE`` drawn registers make longer, ``SALTS`` for each."""
    drawn = [np.random.default_rng([turn, salt]).choice(m, MORE, replace=False) for salt in range(SALTS)]

    def keys(batches):
        for batch in batches:
            r = text_buffer(batch.column("registers"))[0].view(np.uint16).reshape(-1, m)
            key = np.asarray(batch.column("key")).view(np.uint64)
            for salt, at in enumerate(drawn):
                k = mix64(key, 31 + salt)
                for x in at.tolist():
                    k = mix64(k ^ r[:, x].astype(np.uint64), 30)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(k.view(np.int64)), batch.column("out")], ["node", "key", "out"])

    return rest.join(nodes.select("node", "registers"), "node").select("node", "key", "out", "registers").mapInArrow(keys, "node long, key long, out boolean")


def _candidates(bands: DataFrame, nodes: DataFrame, m: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of members and hubs that join the nodes to candidate clusters."""
    # A near copy of a member closer to the hub than this is not rejected by it: distances add up, and 0.1 is for the estimates.
    settled = LEAST_ESTIMATE + 1 - percent / 100 + 0.1
    found, turn = None, 0
    bands = bands.withColumn("out", F.lit(True))
    open_ = lambda rows, *more: rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("out").alias("any"), *more).filter("n > 1 and any")
    while True:
        hubs = materialize(open_(bands, F.min_by("node", F.xxhash64("node", "key")).alias("hub")).select("key", "hub"), "hubs")
        if found is not None and hubs.isEmpty():
            return found
        members = bands.join(hubs, "key").filter("node <> hub").select("key", "node", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        pairs = materialize(members.select("a", "b").distinct(), "pairs")
        estimates = materialize(_estimated(pairs, nodes, m), "estimates")
        close = estimates.filter(F.col("similarity") >= LEAST_ESTIMATE).select("a", "b")
        found = close if found is None else found.unionByName(close)
        # Members that were all accepted are joined by their hub already; a rejected one makes its bucket go on.
        far = estimates.filter(F.col("similarity") < settled)
        rest = materialize(members.join(far, ["a", "b"]).select("key", "node", (F.col("similarity") < LEAST_ESTIMATE).alias("out")), "rest")
        turn += 1
        bands = materialize(_longer(rest.join(open_(rest).select("key"), "key"), nodes, m, turn), "bands")


def linked(nodes: np.ndarray, cluster: np.ndarray, sets: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join the nodes of each cluster as all pairs with 100 |a & b| >= percent |a | b| do."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    # Shingles of different clusters are different; postings list the sets of each shingle.
    order = np.lexsort((owner, sets, cluster[owner]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sets[order][1:] != sets[order][:-1]) | (cluster[owner[order]][1:] != cluster[owner[order]][:-1])
    ids = np.cumsum(fresh) - 1
    posting = owner[order]
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(order)))
    local = np.empty(len(order), np.int64)
    local[order] = ids
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - begin[ids]
    parent = list(range(len(n)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in range(len(n)):
        at = slice(bounds[x], bounds[x + 1])
        terms, before = local[at], rank[at]
        some = before > 0
        if not some.any():
            continue
        # Sets before x on each posting list.
        starts, counts = begin[terms[some]], before[some]
        ends = np.cumsum(counts)
        others = posting[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
        distinct, common = np.unique(others, return_counts=True) if ends[-1] < 4 * len(n) else (lambda c: (np.flatnonzero(c), c[c > 0]))(np.bincount(others, minlength=x))
        hit = 100 * common >= percent * (n[x] + n[distinct] - common)
        for y in distinct[hit].tolist():
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(nodes[x]), int(nodes[y])))
    return edges


def _confirmed(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges between the nodes of each cluster, ``members`` being ``node``, ``cluster``, ``n`` (members) and ``bytes``."""
    total = members.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, int(total // TASK_BYTES))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block of a large cluster meets every other block once: pair (i, j) with i <= j is a task of its own.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("with", other)
    pair = F.struct(F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    task = F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("t"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("cluster").alias("t"), pair["i"].alias("i"), pair["j"].alias("j")))
    rows = texts.join(dealt.select("node", "cluster", task.alias("task")).hint("merge"), "node")

    def confirm(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        data, offsets = text_buffer(group.column("text"))
        sets, bounds = shingle_sets(data, offsets, width)
        edges = linked(np.asarray(group.column("node")), np.asarray(group.column("cluster")), sets, bounds, percent)
        a, b = zip(*edges, strict=True) if edges else ((), ())
        del data, sets
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("task").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Documents are linked if 100 times the size of their sets' intersection is at least ``percent`` times that of the
    union; ``component_id`` is the smallest doc_id reachable. Null, empty and wordless texts have no shingles and no
    links. Rows that share a doc_id are one document; a row without doc_id stays alone with a null component and is
    kept. Other columns are left aside. No rows give no rows.
    """
    m = BAND * bands_for(percent)
    drawn = materialize(sketches(docs, width, m), "sketches")
    some = drawn.filter("n_shingles > 0 and doc_id is not null")
    # Written out, so that the join below deals both sides anew and can split a hot set.
    reps = materialize(some.groupBy("n_shingles", "f0", "f1").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers")), "sets")
    bands = materialize(_bands(reps, m), "bands")
    weak = components(_candidates(bands, reps.select("node", "registers", "n_shingles"), m, percent))
    sizes = materialize(weak.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    members = weak.join(sizes, "label").select("node", F.col("label").alias("cluster"), "n").join(reps.select("node", (F.col("n_shingles") * 8).alias("bytes")), "node")
    classes = components(_confirmed(materialize(members, "members"), docs, width, percent))
    nodes = materialize(reps.drop("registers").join(classes, "node", "left").select("n_shingles", "f0", "f1", F.coalesce("label", "node").alias("component_id")), "classes")
    out = drawn.drop("registers").join(nodes, ["n_shingles", "f0", "f1"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


ORACLE_SQL = {
    "op5_near_dedup": r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as r(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
frequent as (select s from grams group by s having count(*) > 1),
shared as (select * from grams where s in (select s from frequent)),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shared a join shared b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from docs union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept
from docs d left join sizes s using (doc_id) join reach r on r.a = d.doc_id group by d.doc_id, s.n
""",
}
