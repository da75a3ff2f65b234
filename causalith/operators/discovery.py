"""Proposals of a causal graph from data: PC, FCI and DirectLiNGAM.

Rows are seen in sums only: a correlation matrix (one pass, all bootstrap samples of a block with it) for the constraint-based
searches, moments of residuals for LiNGAM's ordering. What is searched afterwards is a graph of at most 30 nodes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CausalError
from ..functions.draws import poisson
from ..functions.special import two_sided_p
from ..plans.frame import as_double, column, is_number, ranked
from ..plans.ordinals import numbered
from ..plans.rows import SparkRows
from ..plans.storage import stored
from ..sources.relation import resolve
from .graph import UNREVIEWED

ALGORITHMS = ("pc", "fci", "lingam", "pc+lingam", "both")


class Table:
    """Complete rows of 2 to 30 numeric columns."""

    def __init__(self, engine, relation, columns, exclude, groups=None):
        df = resolve(engine.spark, relation)
        left = {column(df, e) for e in exclude or []}
        if groups:
            left.add(column(df, groups))
        names = [column(df, c) for c in columns] if columns else [c for c in df.columns if c not in left and (is_number(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType))]
        for c in names:
            if not (is_number(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)):
                raise CausalError(f'"{c}" is not numeric')
        if not 2 <= len(names) <= 30:
            raise CausalError(f"discovery needs 2 to 30 numeric columns; there are {len(names)}")
        x = [as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)]
        group = [F.col(f"`{column(df, groups)}`").cast("string").alias("_group")] if groups else []
        rows = df.select(*x, *group).dropna()
        for i in range(len(names)):
            rows = rows.filter(~F.isnan(f"x{i}"))
        self.names, self.p = names, len(names)
        self.df = numbered(rows.withColumn("_key", F.xxhash64(*(f"x{i}" for i in range(self.p)))).persist()).persist()
        stats = self.df.agg(F.count(F.lit(1)).alias("n"), *(F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(self.p))).first()
        self.n = stats["n"]
        if self.n < self.p + 10:
            raise CausalError(f"only {self.n} complete rows; at least {self.p + 10} are needed")
        for i, c in enumerate(names):
            if not (stats[f"s{i}"] or 0) > 1e-12:
                raise CausalError(f'"{c}" is constant')

    def normal_scores(self) -> list[str]:
        """Replace each column by the normal quantiles of its average ranks; warnings."""
        warnings, df = [], stored(self.df.withColumn("_row", F.monotonically_increasing_id()), "scores")
        for i, c in enumerate(self.names):
            x = f"x{i}"
            counts = stored(df.groupBy(x).agg(F.count(F.lit(1)).alias("m")), "counts")
            if counts.limit(10).count() < 10:
                warnings.append(f'"{c}" has fewer than 10 distinct values: ranks say little')
            # Ranks of distinct values need the rows before them: values in order, summed by partition first.
            ordered = ranked(counts, [x], "_k")
            width = max(1, counts.count() // 64)
            block = F.expr(f"_k div {width}")
            sums = ordered.groupBy(block.alias("b")).agg(F.sum("m").alias("s")).collect()
            before, rows = 0, []
            for b, s in sorted((r[0], r[1]) for r in sums):
                rows.append((b, before))
                before += s
            start = df.sparkSession.createDataFrame(rows, "b long, start long")
            inside = F.sum("m").over(Window.partitionBy("b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
            place = ordered.withColumn("b", block).join(F.broadcast(start), "b").withColumn("rank", F.col("start") + F.coalesce(inside, F.lit(0)) + (F.col("m") + 1) / 2)  # at most 65 blocks
            df = df.join(place.select(x, "rank"), x).drop(x).withColumnRenamed("rank", x)
            df = stored(df, "scores")
        n = self.n
        rows = SparkRows(df.select(*(f"x{i}" for i in range(self.p)), "_key"), self.p)

        def quantiles(c):
            from statistics import NormalDist

            inv = NormalDist().inv_cdf
            out = []
            for j in range(c["X"].shape[1]):
                v, back = np.unique(c["X"][:, j] / (n + 1), return_inverse=True)
                out.append(np.array([inv(min(max(u, 1e-12), 1 - 1e-12)) for u in v])[back])
            return out

        self.df = rows.append(quantiles, [f"x{i}" for i in range(self.p)]).df.persist()
        return warnings

    def correlations(self, reps: int, seed: int) -> np.ndarray:
        """Correlation matrix of the rows, and of ``reps`` bootstrap samples."""
        out, p = [], self.p
        rows = SparkRows(self.df, p)
        mean = rows.sum(lambda c: {"s": c["X"].sum(0)})["s"] / self.n
        for first in range(-1, reps, 50):
            some = range(first, min(reps, first + 50))

            def sums(c, some=some):
                z = np.hstack([np.ones((len(c["X"]), 1)), c["X"] - mean])
                return {"s": np.stack([(z * (np.ones(len(z)) if r < 0 else poisson(c["_key"], seed, r))[:, None]).T @ z for r in some])}

            out.append(rows.sum(sums)["s"])
        g = np.concatenate(out)
        n = g[:, :1, :1]
        cov = g[:, 1:, 1:] / n - g[:, 1:, :1] * g[:, :1, 1:] / n**2
        sd = np.sqrt(np.maximum(np.einsum("kii->ki", cov), 1e-300))
        return cov / sd[:, :, None] / sd[:, None, :]


class PartialTest:
    """Fisher's z test of partial correlations."""

    def __init__(self, corr: np.ndarray, n: int, alpha: float):
        self.corr, self.n, self.alpha = corr, n, alpha

    def independent(self, i: int, j: int, given) -> bool:
        k = [i, j, *given]
        dof = self.n - len(given) - 3
        if dof < 1:
            return True
        inv = np.linalg.pinv(self.corr[np.ix_(k, k)])
        r = -inv[0, 1] / np.sqrt(max(inv[0, 0] * inv[1, 1], 1e-300))
        r = min(max(r, -1 + 1e-12), 1 - 1e-12)
        return two_sided_p(0.5 * np.log((1 + r) / (1 - r)) * np.sqrt(dof)) > self.alpha


def skeleton(test, p: int, most: int):
    """Adjacency and separating sets; neighbours are frozen within a level."""
    adj, apart = ~np.eye(p, dtype=bool), {}
    for level in range(most + 1):
        frozen = adj.copy()
        any_left = False
        for i, j in combinations(range(p), 2):
            if not adj[i, j]:
                continue
            for a, b in ((i, j), (j, i)):
                near = [k for k in range(p) if frozen[a, k] and k != b]
                if len(near) < level:
                    continue
                any_left = True
                found = next((s for s in combinations(near, level) if test.independent(i, j, s)), None)
                if found is not None:
                    adj[i, j] = adj[j, i] = False
                    apart[(i, j)] = set(found)
                    break
        if not any_left:
            break
    return adj, apart


def pc(test, p: int, most: int, tier: dict[int, int]) -> np.ndarray:
    """Marks: m[i, j] is 1 if the edge i - j may point to j; directed i -> j is m[i, j] = 1, m[j, i] = 0."""
    adj, apart = skeleton(test, p, most)
    m = adj.astype(np.int8)

    def orient(a, b):
        if m[a, b] and m[b, a] and not (a in tier and b in tier and tier[a] > tier[b]):
            m[b, a] = 0

    for i, j in combinations(range(p), 2):
        if adj[i, j] and i in tier and j in tier and tier[i] != tier[j]:
            a, b = (i, j) if tier[i] < tier[j] else (j, i)
            m[b, a] = 0
    for k in range(p):
        for i, j in combinations([x for x in range(p) if adj[x, k]], 2):
            if not adj[i, j] and k not in apart.get((i, j), set()) and m[i, k] and m[j, k]:
                orient(i, k)
                orient(j, k)
    changed = True
    while changed:
        before = m.copy()
        for a in range(p):
            for b in range(p):
                if not (m[a, b] and m[b, a]):
                    continue
                into = [c for c in range(p) if m[c, a] and not m[a, c]]
                if any(not adj[c, b] for c in into if c != b):
                    orient(a, b)
                elif any(m[a, c] and not m[c, a] and m[c, b] and not m[b, c] for c in range(p)):
                    orient(a, b)
                else:
                    both = [c for c in range(p) if m[a, c] and m[c, a] and m[c, b] and not m[b, c]]
                    if any(not adj[c, d] for c, d in combinations(both, 2)):
                        orient(a, b)
        changed = bool((m != before).any())
    return m


# Marks of FCI at the far end of an edge: circle, arrow, tail.
CIRCLE, ARROW, TAIL = 1, 2, 3


def fci(test, p: int, most: int, tier: dict[int, int]) -> np.ndarray:
    """Marks of a partial ancestral graph: m[i, j] is the mark at j of the edge i - j, 0 without one."""
    adj, apart = skeleton(test, p, most)

    def colliders():
        m = np.where(adj, CIRCLE, 0)
        for k in range(p):
            for i, j in combinations([x for x in range(p) if adj[x, k]], 2):
                if not adj[i, j] and k not in apart.get((i, j), set()):
                    m[i, k] = m[j, k] = ARROW
        return m

    m = colliders()
    for i in range(p):
        # Nodes that a path from i reaches whose inner nodes are colliders or lie in triangles.
        reach, todo = set(), [(i, j) for j in range(p) if adj[i, j]]
        seen = set(todo)
        while todo:
            a, b = todo.pop()
            reach.add(b)
            for c in range(p):
                if c not in (a, i) and adj[b, c] and (b, c) not in seen and ((m[a, b] == ARROW and m[c, b] == ARROW) or adj[a, c]):
                    seen.add((b, c))
                    todo.append((b, c))
        for j in [x for x in range(p) if adj[i, x]]:
            pool = sorted(reach - {i, j})
            for size in range(min(most, len(pool)) + 1):
                found = next((s for s in combinations(pool, size) if test.independent(i, j, s)), None)
                if found is not None:
                    adj[i, j] = adj[j, i] = False
                    apart[tuple(sorted((i, j)))] = set(found)
                    break
    m = colliders()
    for i, j in combinations(range(p), 2):
        if adj[i, j] and i in tier and j in tier and tier[i] != tier[j]:
            a, b = (i, j) if tier[i] < tier[j] else (j, i)
            m[a, b] = ARROW
    changed = True
    while changed:
        before = m.copy()
        for a in range(p):
            for b in range(p):
                if not m[a, b]:
                    continue
                for c in range(p):
                    if c in (a, b) or not m[b, c]:
                        continue
                    if m[a, b] == ARROW and m[c, b] == CIRCLE and not adj[a, c]:  # R1
                        m[c, b], m[b, c] = TAIL, ARROW
                    if m[a, c] == CIRCLE and ((m[a, b] == ARROW and m[b, a] == TAIL and m[b, c] == ARROW) or (m[a, b] == ARROW and m[b, c] == ARROW and m[c, b] == TAIL)):  # R2
                        m[a, c] = ARROW
                    if m[a, c] and m[c, a] == CIRCLE and m[a, c] == ARROW and m[b, a] == TAIL and m[c, b] == TAIL and m[a, b] in (ARROW, CIRCLE) and m[b, c] == ARROW:  # R8
                        m[c, a] = TAIL
                    if m[a, b] == ARROW and m[c, b] == ARROW and not adj[a, c]:  # R3
                        for d in range(p):
                            if d not in (a, b, c) and m[a, d] == CIRCLE and m[c, d] == CIRCLE and m[d, b] == CIRCLE:
                                m[d, b] = ARROW
        for d, b, c in ((d, b, c) for d in range(p) for b in range(p) for c in range(p) if len({d, b, c}) == 3):
            # R4: a discriminating path from d to c for b.
            if not (m[b, c] and m[c, b] == CIRCLE and not adj[d, c]):
                continue
            if _discriminates(m, adj, d, b, c, p):
                if b in apart.get(tuple(sorted((d, c))), set()):
                    m[c, b], m[b, c] = TAIL, ARROW
                else:
                    for a in range(p):
                        if m[a, b] and m[a, c] == ARROW and m[c, a] == TAIL:
                            m[a, b] = ARROW
                    m[b, c] = m[c, b] = ARROW
        for a, c in ((a, c) for a in range(p) for c in range(p) if m[a, c] == ARROW and m[c, a] == CIRCLE):
            starts = [b for b in range(p) if b not in (a, c) and m[a, b] in (CIRCLE, ARROW) and m[b, a] in (CIRCLE, TAIL)]
            if any(not adj[b, c] and _directed_path(m, adj, a, b, c, p) for b in starts):  # R9
                m[c, a] = TAIL
                continue
            ends = [b for b in range(p) if b not in (a, c) and m[b, c] == ARROW and m[c, b] == TAIL]
            if any(not adj[u, v] and _to(m, adj, a, u, x, p) and _to(m, adj, a, v, y, p) for x, y in combinations(ends, 2) for u in starts for v in starts if u != v):  # R10
                m[c, a] = TAIL
        changed = bool((m != before).any())
    return m


def _open(m, a, b) -> bool:
    return m[a, b] in (CIRCLE, ARROW) and m[b, a] in (CIRCLE, TAIL)


def _directed_path(m, adj, a, b, c, p, budget: int = 100_000) -> bool:
    """An uncovered path a, b, ..., c that may be directed."""
    paths = [[a, b]]
    while paths and budget:
        path = paths.pop()
        budget -= 1
        u, v = path[-2:]
        if v == c:
            return True
        for w in range(p):
            if w not in path and _open(m, v, w) and not adj[u, w]:
                paths.append([*path, w])
    return False


def _to(m, adj, a, first, end, p) -> bool:
    return first == end or _directed_path(m, adj, a, first, end, p)


def _discriminates(m, adj, d, b, c, p, budget: int = 100_000) -> bool:
    """Whether a path d, ..., b exists whose inner nodes are colliders on it and parents of c."""
    paths = [[b]]
    while paths and budget:
        path = paths.pop()
        budget -= 1
        v = path[-1]
        for w in range(p):
            if w in path or w == c or not m[w, v]:
                continue
            if len(path) > 1 and not m[w, v] == ARROW:
                continue
            if w == d:
                if len(path) > 1:
                    return True
                continue
            if m[w, c] == ARROW and m[c, w] == TAIL and m[v, w] == ARROW:
                paths.append([*path, w])
    return False


#: Constants of the maximum-entropy approximation of differential entropy.
_K1, _K2, _GAMMA = 79.047, 7.4129, 0.37457


def _entropy(cosh: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    return (1 + np.log(2 * np.pi)) / 2 - _K1 * (cosh - _GAMMA) ** 2 - _K2 * gauss**2


def lingam(rows: SparkRows, n: float, p: int, corr: np.ndarray, mean: np.ndarray, sd: np.ndarray, alpha: float, min_effect: float, tier: dict[int, int]):
    """Coefficients of a linear non-Gaussian model in causal order, the order, and Jarque-Bera p values of its disturbances."""
    left, order = list(range(p)), []
    # Each remaining variable is its own column less its regression on those taken out: rows of ``proj``.
    proj = np.eye(p)
    while len(left) > 1:
        k = len(left)
        cov = proj[left] @ corr @ proj[left].T
        unit = proj[left] / np.sqrt(np.maximum(np.diag(cov), 1e-12))[:, None]
        r = unit @ corr @ unit.T
        scale = 1 / np.sqrt(np.maximum(1 - r**2, 1e-12))

        def sums(c, unit=unit, r=r, scale=scale, k=k):
            z = ((c["X"] - mean) / sd) @ unit.T
            own = np.stack([np.log(np.cosh(np.clip(z, -300, 300))).sum(0), (z * np.exp(-z * z / 2)).sum(0)])
            cross = np.zeros((2, k, k))
            for j in range(k):
                e = (z - z[:, j : j + 1] * r[:, j]) * scale[:, j]
                e[:, j] = 0
                cross[0, :, j] = np.log(np.cosh(np.clip(e, -300, 300))).sum(0)
                cross[1, :, j] = (e * np.exp(-e * e / 2)).sum(0)
            return {"own": own, "cross": cross}

        s = rows.sum(sums)
        h = _entropy(s["own"][0] / n, s["own"][1] / n)
        hr = _entropy(s["cross"][0] / n, s["cross"][1] / n)
        # How much better each variable explains the others than they explain it.
        diff = (h[None, :] + hr) - (h[:, None] + hr.T)
        score = [-(np.minimum(0, np.delete(-diff[:, j], j)) ** 2).sum() for j in range(k)]
        allowed = [j for j in range(k) if not (left[j] in tier and any(x in tier and tier[x] < tier[left[j]] for x in left))] or list(range(k))
        root = max(allowed, key=lambda j: score[j])
        order.append(left[root])
        for j in range(k):
            if j != root:
                b = (proj[left[j]] @ corr @ proj[left[root]]) / max(proj[left[root]] @ corr @ proj[left[root]], 1e-12)
                proj[left[j]] = proj[left[j]] - b * proj[left[root]]
        left.pop(root)
    order.append(left[0])
    coef, residual = np.zeros((p, p)), np.eye(p)
    for i, v in enumerate(order):
        before = order[:i]
        if before:
            inv = np.linalg.pinv(corr[np.ix_(before, before)])
            b = inv @ corr[before, v]
            residual[v, before] = -b
            s2 = max(1 - b @ corr[before, v], 1e-12)
            se = np.sqrt(s2 * np.diag(inv) / max(1, n - len(before) - 1))
            for u, x, s in zip(before, b, se, strict=True):
                if abs(x) >= min_effect and two_sided_p(x / s) < alpha:
                    coef[u, v] = x

    def moments(c):
        e = ((c["X"] - mean) / sd) @ residual.T
        return {"m": np.stack([(e**q).sum(0) for q in (1, 2, 3, 4)])}

    m = rows.sum(moments)["m"] / n
    var = m[1] - m[0] ** 2
    skew = (m[2] - 3 * m[0] * m[1] + 2 * m[0] ** 3) / var**1.5
    kurt = (m[3] - 4 * m[0] * m[2] + 6 * m[0] ** 2 * m[1] - 3 * m[0] ** 4) / var**2 - 3
    return coef, order, np.exp(-n / 6 * (skew**2 + kurt**2 / 4) / 2)


def _tiers(tiers, names) -> dict[int, int]:
    if not tiers:
        return {}
    if len(tiers) < 2:
        raise CausalError("tiers need at least two lists")
    low, out = [n.lower() for n in names], {}
    for k, tier in enumerate(tiers):
        for c in tier:
            if c.lower() not in low:
                raise CausalError(f'tiers name the unknown column "{c}"')
            i = low.index(c.lower())
            if i in out:
                raise CausalError(f'tiers name "{c}" twice')
            out[i] = k
    return out


def _edge(a: int, b: int) -> str:
    """Text of an edge from its marks at the near and the far end."""
    near, far = {CIRCLE: "o", ARROW: "<", TAIL: "-"}[a], {CIRCLE: "o", ARROW: ">", TAIL: "-"}[b]
    return f"{near}-{far}" if (near, far) != ("-", "-") else "---"


def discover(engine, relation, columns=None, exclude=None, alpha=0.01, max_conditioning=3, bootstrap=50, seed=None, algorithm="pc", test="pearson", min_effect=0.05, tiers=None, groups=None):
    """The search behind do_discover: names, a row for each pair, and warnings."""
    algorithm = "pc+lingam" if algorithm == "both" else algorithm
    if algorithm not in ALGORITHMS:
        raise CausalError(f'unknown algorithm "{algorithm}"; use one of {", ".join(ALGORITHMS)}')
    if test not in ("pearson", "rank"):
        raise CausalError(f'unknown test "{test}"; use pearson or rank')
    if groups and algorithm != "lingam":
        raise CausalError("groups apply to lingam alone")
    if test != "pearson" and algorithm != "pc" and algorithm != "fci":
        raise CausalError("lingam needs the values themselves: use the test pearson")
    seed = engine.config.seed if seed is None else int(seed)
    table = Table(engine, relation, columns, exclude, groups)
    p, warnings = table.p, []
    tier = _tiers(tiers, table.names)
    if test == "rank":
        warnings += table.normal_scores()
    reps = max(0, int(bootstrap))
    corr = table.correlations(reps if algorithm != "lingam" else 0, seed)
    rows = SparkRows(table.df, p)
    found: list[dict] = []
    if algorithm in ("pc", "fci", "pc+lingam"):
        search = fci if algorithm == "fci" else pc
        graphs = [search(PartialTest(c, table.n, alpha), p, int(max_conditioning), tier) for c in corr]
        point, boot = graphs[0], graphs[1:]

        def text(m, i, j):
            if algorithm == "fci":
                return _edge(m[j, i], m[i, j]) if m[i, j] else ""
            return "" if not (m[i, j] or m[j, i]) else "--" if m[i, j] and m[j, i] else "->" if m[i, j] else "<-"

        for i, j in combinations(range(p), 2):
            e = text(point, i, j)
            others = [text(m, i, j) for m in boot]
            stability = sum(bool(o) for o in others) / len(others) if others else 1.0 if e else 0.0
            same = sum(o == e for o in others) / len(others) if others and e else (1.0 if e else 0.0)
            found.append({"i": i, "j": j, "edge": e, "stability": stability, "same": same})
    if algorithm in ("lingam", "pc+lingam"):
        mean = rows.sum(lambda c: {"s": c["X"].sum(0)})["s"] / table.n
        sd = np.sqrt(rows.sum(lambda c: {"s": ((c["X"] - mean) ** 2).sum(0)})["s"] / table.n)
        parts = [(rows, table.n, corr[0], mean, sd)]
        if groups:
            sizes = {r[0]: r[1] for r in table.df.groupBy("_group").count().collect()}
            if not 2 <= len(sizes) <= 50:
                raise CausalError("groups need 2 to 50 values")
            parts = []
            for g, n in sorted(sizes.items()):
                if n < p + 10:
                    raise CausalError(f'the group "{g}" has only {n} rows')
                own = SparkRows(table.df.filter(F.col("_group") == g), p).keep()
                mu = own.sum(lambda c: {"s": c["X"].sum(0)})["s"] / n
                cov = own.sum(lambda c, mu=mu: {"s": (c["X"] - mu).T @ (c["X"] - mu)})["s"] / n
                s = np.sqrt(np.diag(cov))
                parts.append((own, n, cov / np.outer(s, s), mu, s))
        fits = [lingam(r, n, p, c, mu, s, alpha, min_effect, tier) for r, n, c, mu, s in parts]
        if sum(x > 0.05 for x in fits[0][2]) >= 2:
            raise CausalError("at least two disturbances look Gaussian: LiNGAM cannot order the variables")
        votes = np.sum([f[0] != 0 for f in fits], axis=0)
        need = (len(fits) + 1) // 2 if len(fits) > 1 else 1
        mine = {(i, j): ("->" if votes[i, j] >= need else "<-" if votes[j, i] >= need else "") for i, j in combinations(range(p), 2)}
        share = {(i, j): max(votes[i, j], votes[j, i]) / len(fits) for i, j in combinations(range(p), 2)}
        if algorithm == "lingam":
            found = [{"i": i, "j": j, "edge": e, "stability": share[i, j], "same": share[i, j] if e else 0.0} for (i, j), e in mine.items()]
        else:
            for f in found:
                e = mine[f["i"], f["j"]]
                f["agreement"] = "neither" if not e and not f["edge"] else "lingam only" if not f["edge"] else "pc only" if not e else "agree" if e == f["edge"] else "lingam orients" if f["edge"] == "--" else "conflict"
                if e and (not f["edge"] or f["edge"] == "--"):
                    f["edge"] = e
    return table.names, found, warnings, algorithm


def do_discover(engine, relation, **given):
    """Pairs of columns with an edge, or with one in a quarter of the bootstrap samples."""
    names, found, warnings, algorithm = discover(engine, relation, **given)
    out = []
    for f in found:
        if not f["edge"] and f["stability"] < 0.25:
            continue
        a, b, e = names[f["i"]], names[f["j"]], f["edge"]
        if e in ("<-", "<-o", "<--"):
            a, b, e = b, a, {"<-": "->", "<-o": "o->", "<--": "-->"}[e]
        row = [a, b, e or "none", bool(f["edge"]), f["stability"], f["same"]]
        out.append((*row, *([f["agreement"]] if algorithm == "pc+lingam" else []), warnings))
    extra = "agreement string, " if algorithm == "pc+lingam" else ""
    return engine.table(out, f"source string, target string, edge string, in_graph boolean, stability double, orientation_stability double, {extra}warnings array<string>")


def do_discover_dot(engine, relation, **given):
    """The proposal as a graph to be reviewed."""
    names, found, _, algorithm = discover(engine, relation, **given)
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines, directed, undirected, both = [], 0, 0, 0
    for f in found:
        a, b, e = quote(names[f["i"]]), quote(names[f["j"]]), f["edge"]
        if not e:
            continue
        if e in ("->", "-->"):
            lines.append(f"  {a} -> {b};")
            directed += 1
        elif e in ("<-", "<--"):
            lines.append(f"  {b} -> {a};")
            directed += 1
        elif e == "<->":
            both += 1
            hidden = quote(f"latent_{both}")
            lines.append(f"  {hidden} [latent]; {hidden} -> {a}; {hidden} -> {b};")
        else:
            lines.append(f"  {a} -- {b}; // undecided")
            undirected += 1
    text = f"// {UNREVIEWED}\n// Check every edge, decide the undecided ones, then take out these comments.\ndigraph {{\n" + "\n".join([*(f"  {quote(n)};" for n in names), *lines]) + "\n}\n"
    row = (text, len(names), directed, undirected)
    if algorithm == "fci":
        return engine.table([(*row, both)], "dot string, n_nodes long, n_directed long, n_undirected long, n_bidirected long")
    return engine.table([row], "dot string, n_nodes long, n_directed long, n_undirected long")
