"""What would happen under an intervention, and whom to treat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..errors import CausalError
from ..functions.models import classical, fit_logistic, fit_ridge, penalty, predict, sandwich
from ..functions.special import Z95
from ..plans.frame import Spec, build, grouped_order_statistics, ranked
from .effects import effects_of_rows, numbered
from .nuisance import X, mean_of, nuisance, pseudo


def do_counterfactual(engine, relation, **given):
    """Each row's predicted outcome under control and treatment, and its effect."""
    spec = Spec.of(engine.config, **given)
    frame, _, rows, _ = effects_of_rows(engine, relation, spec)
    df = numbered(rows.df, spec, frame.width)
    return df.select("row_id", F.col("_id").alias("id"), F.col("_t").alias("treatment"), F.col("_y").alias("observed"), F.col("_m0").alias("y0"), F.col("_m1").alias("y1"), F.col("_cate").alias("effect"), F.col("_low").alias("effect_low"), F.col("_high").alias("effect_high"))


def do_predict(engine, relation, intervention: dict | None = None, **given):
    """Each row's outcome with some columns set to given values, by a model of each arm."""
    spec = Spec.of(engine.config, **given)
    if not intervention:
        raise CausalError("intervention is required: a value for each column that is set")
    frame = build(engine, relation, spec)
    rows, binary = frame.rows, frame.binary_outcome
    models = [lambda c, a=a: ((c["_t"] == a).astype(float), c["_y"]) for a in (0, 1)]
    betas = (fit_logistic if binary else fit_ridge)(rows, X, models)
    cov = None
    if not binary:
        cov = []
        for a in (0, 1):
            n = frame.n_treated if a else frame.n - frame.n_treated
            cov.append((sandwich(rows, X, models[a], betas[a], penalty(n), True) if frame.clustered else classical(rows, X, models[a], betas[a], penalty(n))))
    fixed, arm = {}, None
    for name, v in intervention.items():
        if name.lower() == spec.treatment.lower():
            text = str(v).lower() if isinstance(v, bool) else str(v)
            arm = 1.0 if text == frame.treated_label else 0.0 if text == frame.control_label else float(float(v) != 0)
            continue
        own = [j for j, f in enumerate(frame.features) if f.source.lower() == name.lower()]
        if not own:
            raise CausalError(f'"{name}" is neither the treatment nor a covariate of the model')
        for j in own:
            f = frame.features[j]
            raw = 0.0 if f.kind == "MISSING_INDICATOR" else float(str(v) == f.level) if f.kind == "ONE_HOT" else float(v)
            fixed[j] = (raw - f.center) / f.scale

    def outcome(c):
        x = c["X"].copy()
        for j, v in fixed.items():
            x[:, j] = v
        t = c["_t"] if arm is None else np.full(len(x), arm)
        mean = np.where(t == 1, predict(x, betas[1], binary), predict(x, betas[0], binary))
        if cov is None:
            return [mean, np.full(len(x), np.nan), np.full(len(x), np.nan)]
        z = np.hstack([np.ones((len(x), 1)), x])
        se = np.sqrt(np.maximum(np.where(t == 1, np.einsum("ij,jk,ik->i", z, cov[1], z), np.einsum("ij,jk,ik->i", z, cov[0], z)), 0))
        return [mean, mean - Z95 * se, mean + Z95 * se]

    df = numbered(rows.append(outcome, ["_p", "_pl", "_ph"]).df, spec, frame.width)
    text = ", ".join(f"{k} = {v}" for k, v in intervention.items())
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.select("row_id", F.col("_id").alias("id"), F.lit(text).alias("intervention"), F.col("_y").alias("observed"), F.col("_p").alias("predicted"), null("_pl").alias("predicted_low"), null("_ph").alias("predicted_high"))


def _scored(engine, relation, spec: Spec):
    frame, _, rows, _ = effects_of_rows(engine, relation, spec)
    return frame, rows.append(lambda c: [pseudo(c)], ["_psi"]).keep()


def do_policy_value(engine, relation, threshold: float = 0.0, **given):
    """Value of a policy (a column, or effects above a threshold), per row and relative to treating nobody."""
    spec = Spec.of(engine.config, **given)
    frame, rows = _scored(engine, relation, spec)
    if spec.policy:
        take, text = (lambda c: (c["_policy"] != 0).astype(float)), f"column '{spec.policy}'"
    else:
        take, text = (lambda c: (c["_cate"] > threshold).astype(float)), f"cate > {threshold:g}"
    one = lambda c: np.ones(len(c["_t"]))
    value, se, n = mean_of(rows, lambda c: take(c) * c["_psi"], one, frame.clustered)
    s = rows.sum(lambda c: {"s": np.array([take(c).sum(), c["_psi"].sum()])})["s"]
    every = s[1] / n
    return engine.table([(text, int(s[0]), float(s[0] / n), float(value), float(se), float(value - Z95 * se), float(value + Z95 * se), float(every), 0.0, float(value - every))], "policy string, n_targeted long, share_targeted double, policy_value double, std_error double, ci_low double, ci_high double, value_treat_all double, value_treat_none double, lift_over_treat_all double")


def do_uplift(engine, relation, **given):
    """Gain of treating the most promising rows first, in 20 steps."""
    spec = Spec.of(engine.config, **given)
    frame, rows = _scored(engine, relation, spec)
    n = frame.n
    df = ranked(rows.df.select("_cate", "_psi", "_key"), [F.col("_cate").desc(), "_key"], "_rank")
    cuts = [int(n * b / 20 + 0.5) for b in range(1, 21)]
    bucket = F.lit(20)
    for b in range(19, 0, -1):
        bucket = F.when(F.col("_rank") < cuts[b - 1], b).otherwise(bucket)
    sums = {r[0]: r[1] for r in df.groupBy(bucket.alias("b")).agg(F.sum("_psi")).collect()}
    total, running, out = sum(sums.values()), 0.0, []
    for b in range(1, 21):
        running += sums.get(b, 0.0)
        fraction = cuts[b - 1] / n
        out.append((b, fraction, cuts[b - 1], running / n, fraction * total / n, running / n - fraction * total / n))
    return engine.table(out, "bucket long, fraction_targeted double, n_targeted long, cumulative_gain double, random_gain double, qini double")


#: Least rows of a leaf and of a node that is split.
_LEAF, _NODE = 20, 60


def do_optimal_policy(engine, relation, depth: int = 2, threshold: float = 0.0, **given):
    """A shallow tree of whom to treat: each node is split at the decile that gains most net of the cost."""
    spec = Spec.of(engine.config, **given)
    frame = build(engine, relation, spec)
    fit = nuisance(frame.rows, frame.folds, frame.binary_outcome, spec.trim)
    rows = fit.rows.append(lambda c: [pseudo(c)], ["_psi"]).keep()
    cost, leaves = float(threshold), []

    def raw(j: int, v: float) -> str:
        f = frame.features[j]
        return f"{v * f.scale + f.center:.4g}"

    def inside(c, path) -> np.ndarray:
        m = np.ones(len(c["_psi"]), bool)
        for j, v, low in path:
            m &= (c["X"][:, j] <= v) == low
        return m

    def rule(j: int, v: float, low: bool) -> str:
        return f"{frame.features[j].name} {'<=' if low else '>'} {raw(j, v)}"

    def cuts_of(nodes: dict[int, tuple[list, int]]) -> dict[int, list[float]]:
        """The deciles of each feature in each node, by node times width plus feature: one sort for all."""
        node = F.lit(None).cast("long")
        for i, (path, _) in nodes.items():
            here = F.lit(True)
            for j, v, low in path:
                here = here & ((F.col(f"x{j}") <= v) if low else (F.col(f"x{j}") > v))
            node = F.when(here, i).otherwise(node)
        values = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("v")) for j in range(frame.width)))
        stacked = rows.df.select(node.alias("node"), F.inline(values)).filter("node is not null").select((F.col("node") * frame.width + F.col("j")).alias("k"), "v")
        places = {i * frame.width + j: [min(n - 1, n * b // 10) for b in range(1, 10)] for i, (_, n) in nodes.items() for j in range(frame.width)}
        return {k: sorted(set(found)) for k, found in grouped_order_statistics(stacked, places).items()}

    # All nodes of a depth share the passes over the rows.
    level, left = [[]], min(3, max(0, int(depth)))
    while level:
        def totals(c, level=level):
            return {str(i): np.array([len(psi := c["_psi"][inside(c, path)]), psi.sum(), (psi**2).sum()]) for i, path in enumerate(level)}

        stats = rows.sum(totals)
        nodes = {i: (path, int(stats[str(i)][0])) for i, path in enumerate(level) if left and stats[str(i)][0] >= _NODE and frame.width}
        best: dict[int, tuple] = {}
        if nodes:
            cuts = cuts_of(nodes)

            def sums(c, nodes=nodes, cuts=cuts):
                out = {}
                for i, (path, _) in nodes.items():
                    m = inside(c, path)
                    x, psi = c["X"][m], c["_psi"][m]
                    for j in range(x.shape[1]):
                        out[f"{i * x.shape[1] + j}"] = np.array([[(low := x[:, j] <= v).sum(), psi[low].sum()] for v in cuts[i * x.shape[1] + j]])
                return out

            found = rows.sum(sums)
            for i, (_, n) in nodes.items():
                total = stats[str(i)][1]
                for j in range(frame.width):
                    for v, (k, psi) in zip(cuts[i * frame.width + j], found[f"{i * frame.width + j}"], strict=True):
                        if k < _LEAF or n - k < _LEAF:
                            continue
                        low, high = psi - cost * k, (total - psi) - cost * (n - k)
                        gain = max(low, 0) + max(high, 0) - max(total - cost * n, 0)
                        if gain > 1e-9 and (i not in best or gain > best[i][0]):
                            best[i] = (gain, j, v)
        deeper = []
        for i, path in enumerate(level):
            if i in best:
                deeper += [[*path, (*best[i][1:], low)] for low in (True, False)]
                continue
            s = stats[str(i)]
            n, mean = int(s[0]), s[1] / s[0]
            se = np.sqrt(max(s[2] / n - mean**2, 0) / max(1, n - 1))
            treat = mean > cost
            leaves.append((" and ".join(rule(*r) for r in path) or "everyone", n, float(mean), float(se), cost, "treat" if treat else "do not treat", float(n * (mean - cost)) if treat else 0.0))
        level, left = deeper, left - 1
    out = [(i + 1, *leaf) for i, leaf in enumerate(sorted(leaves))]
    return engine.table(out, "leaf long, rule string, n long, mean_effect double, std_error double, cost double, action string, expected_gain double")
