"""Panels: difference in differences, event studies and synthetic control."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CausalError
from ..functions.draws import poisson, uniform
from ..functions.models import design, penalty, sigmoid, solve
from ..plans.frame import Spec, as_double, column, is_number
from ..plans.rows import SparkRows
from ..plans.storage import stored
from ..sources.relation import resolve
from .identification import _spread

#: The most periods of a panel; their list is held by the driver and by each task.
_PERIODS = 10_000


class Panel:
    """Rows ``unit, p`` (number of the period), ``y, first`` (period of adoption, null for never) and covariates ``x0..``."""

    def __init__(self, engine, relation, unit, period, spec: Spec, covariates: bool = True):
        df = resolve(engine.spark, relation)
        if not unit or not period or not spec.outcome:
            raise CausalError("unit, period, treatment and outcome are required")
        unit, period, t, y = (column(df, c) for c in (unit, period, spec.treatment, spec.outcome))
        base = df.select(F.col(f"`{unit}`").cast("string").alias("unit"), F.col(f"`{period}`").alias("period"), (as_double(df, t) if not isinstance(df.schema[t].dataType, T.StringType) else F.col(f"`{t}`").cast("boolean").cast("double")).alias("d"), as_double(df, y).alias("y"), *(as_double(df, column(df, c)).alias(f"c{i}") for i, c in enumerate(spec.covariates or [])))
        base = base.filter("unit is not null and period is not null and y is not null")
        periods = [r[0] for r in base.select("period").distinct().orderBy("period").limit(_PERIODS + 1).collect()]
        if len(periods) < 2:
            raise CausalError("the panel needs at least two periods")
        if len(periods) > _PERIODS:
            raise CausalError(f'"{period}" has more than {_PERIODS} values: use coarser periods')
        self.periods = periods
        index = engine.spark.createDataFrame([(p, i) for i, p in enumerate(periods)], T.StructType([base.schema["period"], T.StructField("p", T.IntegerType())]))
        rows = base.join(F.broadcast(index), "period")  # one row for each period
        first = F.min(F.when(F.col("d") != 0, F.col("p"))).over(Window.partitionBy("unit"))
        rows = rows.withColumn("first", first)
        self.width = len(spec.covariates or []) if covariates else 0
        if self.width:
            for c in spec.covariates:
                if not (is_number(df.schema[column(df, c)].dataType) or isinstance(df.schema[column(df, c)].dataType, T.BooleanType)):
                    raise CausalError(f'the covariate "{c}" must be numeric or boolean')
            start = F.min("p").over(Window.partitionBy("unit"))
            units = rows.withColumn("s", start).filter("p = s").select("unit", *(f"c{i}" for i in range(self.width))).dropDuplicates(["unit"])
            stats = units.agg(*(f(f"c{i}").alias(f"{k}{i}") for i in range(self.width) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
            x = [((F.coalesce(F.col(f"c{i}"), F.lit(stats[f"m{i}"])) - stats[f"m{i}"]) / (stats[f"s{i}"] if (stats[f"s{i}"] or 0) > 1e-12 else 1.0)).alias(f"x{i}") for i in range(self.width)]
            rows = rows.select("unit", "p", "y", "first").join(units.select("unit", *x), "unit")
        else:
            rows = rows.select("unit", "p", "y", "first")
        self.rows = stored(rows, "panel")
        seen = self.rows.agg(F.count_distinct("unit").alias("units"), F.count_distinct(F.when(F.col("first").isNull(), F.col("unit"))).alias("never")).first()
        self.units, self.never = seen["units"], seen["never"]
        if self.units < 4:
            raise CausalError("the panel needs at least four units")
        self.cohorts = [r[0] for r in self.rows.filter("first >= 1").select("first").distinct().orderBy("first").collect()]
        if not self.cohorts:
            raise CausalError("no unit starts treatment after the first period")


def _changes(panel: Panel, event: bool) -> DataFrame:
    """A row for each cell (cohort g, period t) and unit in it: its change since g - 1, and whether it is treated."""
    spark = panel.rows.sparkSession
    cells = [(g, t) for g in panel.cohorts for t in range(len(panel.periods)) if t != g - 1 and (event or t >= g)]
    table = F.broadcast(spark.createDataFrame(cells, "g int, t int"))  # cohorts times periods
    x = [f"x{j}" for j in range(panel.width)]
    now = panel.rows.join(table, F.col("p") == F.col("t"))
    base = panel.rows.select("unit", F.col("p").alias("b"), F.col("y").alias("y0"))
    later = F.greatest("t", "g") if event else F.col("t")
    other = F.col("first").isNull() if panel.never else F.col("first").isNull() | (F.col("first") > later)
    both = now.join(base, ["unit"]).filter("b = g - 1").filter((F.col("first") == F.col("g")) | other)
    key = F.xxhash64("unit")
    return both.select("g", "t", (F.col("y") - F.col("y0")).alias("_y"), F.coalesce(F.col("first") == F.col("g"), F.lit(False)).cast("double").alias("_t"), key.alias("_key"), *x)


def _cells(rows: SparkRows, seed: int, reps: int, width: int) -> dict[tuple, np.ndarray]:
    """Effect and treated count of every cell, for the panel as it is and for bootstrap samples of units."""
    out: dict[tuple, list] = {}
    for first in range(-1, reps, 50):
        some = list(range(first, min(reps, first + 50)))
        draw = lambda c, r: np.ones(len(c["_t"])) if r < 0 else poisson(c["_key"], seed, r)

        def each(c, f):
            cell = c["g"].astype(np.int64) * 100_000 + c["t"].astype(np.int64)
            columns = {n: c[n] for n in ("_t", "_y", "_key", "X")}  # a block makes a column when it is asked for
            found = {}
            for k in np.unique(cell):
                at = cell == k
                found[str(k)] = f({n: v[at] for n, v in columns.items()}, str(k))
            return found

        if not width:
            plain = lambda c, _, some=some: np.stack([[[(w * m).sum(), (w * m * c["_y"]).sum()] for m in (1 - c["_t"], c["_t"])] for r in some for w in [draw(c, r)]])
            for k, v in rows.sum(lambda c: each(c, plain)).items():
                with np.errstate(all="ignore"):
                    m = v[:, :, 1] / v[:, :, 0]
                ok = (v[:, 1, 0] >= 1) & (v[:, 0, 0] >= 1)
                out.setdefault(_cell(k), []).append(np.stack([np.where(ok, m[:, 1] - m[:, 0], np.nan), v[:, 1, 0]], 1))
            continue

        def gram(c, _, some=some):
            x = design(c["X"])
            res = []
            for r in some:
                w = draw(c, r) * (1 - c["_t"])
                xw = x * w[:, None]
                res.append(np.hstack([xw.T @ x, (xw.T @ c["_y"])[:, None]]))
            return np.stack(res)

        outcome = {k: [solve(g[:, :-1], g[:, -1], penalty(g[0, 0])) for g in v] for k, v in rows.sum(lambda c: each(c, gram)).items()}
        member = {k: [np.zeros(width + 1) for _ in some] for k in outcome}
        for _ in range(20):

            def irls(c, k, some=some, member=member):
                x = design(c["X"])
                res = []
                for i, r in enumerate(some):
                    w = draw(c, r)
                    eta = x @ member[k][i]
                    mu = sigmoid(eta)
                    v = np.maximum(mu * (1 - mu), 1e-6)
                    xw = x * (w * v)[:, None]
                    res.append(np.hstack([xw.T @ x, (xw.T @ (eta + (c["_t"] - mu) / v))[:, None]]))
                return np.stack(res)

            moved = 0.0
            for k, v in rows.sum(lambda c: each(c, irls)).items():
                new = [solve(g[:, :-1], g[:, -1], 1.0) for g in v]
                moved = max(moved, max(np.abs(a - b).max() for a, b in zip(new, member[k], strict=True)))
                member[k] = new
            if moved < 1e-7:
                break

        def final(c, k, some=some, outcome=outcome, member=member):
            x = design(c["X"])
            res = []
            for i, r in enumerate(some):
                w = draw(c, r)
                e = c["_y"] - x @ outcome[k][i]
                p = np.clip(sigmoid(x @ member[k][i]), 1e-3, 1 - 1e-3)
                wt, wc = w * c["_t"], w * (1 - c["_t"]) * p / (1 - p)
                res.append([wt.sum(), (wt * e).sum(), wc.sum(), (wc * e).sum(), (w * (1 - c["_t"])).sum()])
            return np.array(res)

        for k, v in rows.sum(lambda c: each(c, final)).items():
            with np.errstate(all="ignore"):
                att = v[:, 1] / v[:, 0] - v[:, 3] / v[:, 2]
            out.setdefault(_cell(k), []).append(np.stack([np.where((v[:, 0] >= 2) & (v[:, 4] >= width + 2), att, np.nan), v[:, 0]], 1))
    return {k: np.concatenate(v) for k, v in out.items()}


def _cell(k: str) -> tuple[int, int]:
    return int(k) // 100_000, int(k) % 100_000


def _pooled(cells: list[np.ndarray]) -> np.ndarray:
    """Effects averaged by their treated counts, for each sample."""
    a = np.stack(cells)
    ok = np.isfinite(a[:, :, 0])
    w = np.where(ok, a[:, :, 1], 0)
    with np.errstate(all="ignore"):
        return (w * np.where(ok, a[:, :, 0], 0)).sum(0) / w.sum(0)


def _study(engine, relation, unit, period, given, event):
    spec = Spec.of(engine.config, **given)
    panel = Panel(engine, relation, unit, period, spec)
    rows = SparkRows(_changes(panel, event), panel.width).keep()
    return spec, panel, _cells(rows, spec.seed, max(spec.bootstrap_reps, 50), panel.width)


def _by_relative(cells: dict) -> dict[int, list]:
    out: dict[int, list] = {}
    for (g, t), v in cells.items():
        out.setdefault(t - g, []).append(v)
    return out


def do_did(engine, relation, unit: str = "", period: str = "", **given):
    """Average effect on the treated over cohorts and periods since adoption."""
    spec, panel, cells = _study(engine, relation, unit, period, given, True)
    own = [v for (g, t), v in cells.items() if t >= g and np.isfinite(v[0, 0])]
    if not own:
        raise CausalError("no cohort has a comparison")
    draws = _pooled(own)
    se, low, high = _spread(float(draws[0]), draws[1:].tolist())
    pre = {k: _pooled(v) for k, v in _by_relative(cells).items() if k < -1}
    worst = max(pre.values(), key=lambda d: abs(d[0]), default=None)
    warnings = []
    if worst is not None and np.isfinite(worst[0]):
        s = _spread(float(worst[0]), worst[1:].tolist())[0]
        if s and abs(worst[0]) > 2 * s:
            warnings.append(f"a pre-treatment effect of {worst[0]:.3g} casts doubt on parallel trends")
    if not panel.never:
        warnings.append("no unit is never treated: those not yet treated are the comparison")
    name = "did-dr" if panel.width else "did"
    return engine.table([("ATT", name, float(draws[0]), se, low, high, panel.units, len(panel.periods), len(panel.cohorts), panel.never, float(worst[0]) if worst is not None and np.isfinite(worst[0]) else None, warnings)], "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, n_units long, n_periods long, n_cohorts long, n_never_treated long, pre_trend double, warnings array<string>")


def do_event_study(engine, relation, unit: str = "", period: str = "", **given):
    """Effects by periods since adoption; the one before adoption is the base."""
    _, _, cells = _study(engine, relation, unit, period, given, True)
    out = []
    for k, v in sorted(_by_relative(cells).items()):
        d = _pooled(v)
        if np.isfinite(d[0]):
            se, low, high = _spread(float(d[0]), d[1:].tolist())
            out.append((k, float(d[0]), se, low, high, int(sum(x[0, 1] for x in v if np.isfinite(x[0, 0]))), k < 0))
    return engine.table(out, "relative_period long, att double, std_error double, ci_low double, ci_high double, n_treated long, is_pre_treatment boolean")


def simplex_weights(a: np.ndarray, b: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """Non-negative weights with sum 1 that bring a @ w nearest to b: accelerated projected gradient, then an active set."""
    n = a.shape[1]
    gram, right = a.T @ a, a.T @ b
    rate = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)

    def onto(v):
        u = np.sort(v)[::-1]
        c = (np.cumsum(u) - 1) / np.arange(1, n + 1)
        return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)

    w = z = np.full(n, 1 / n)
    t = 1.0
    for _ in range(steps):
        new = onto(z - rate * (gram @ z - right))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / s * (new - w)
        done = np.abs(new - w).max() < 1e-12
        w, t = new, s
        if done:
            break
    active = w > 1e-10
    for _ in range(100):
        k = np.flatnonzero(active)
        kkt = np.block([[gram[np.ix_(k, k)] + 1e-12 * np.eye(len(k)), np.ones((len(k), 1))], [np.ones((1, len(k))), np.zeros((1, 1))]])
        try:
            x = np.linalg.solve(kkt, np.append(right[k], 1.0))
        except np.linalg.LinAlgError:
            return w
        if (x[:-1] < -1e-12).any():
            active[k[np.argmin(x[:-1])]] = False
            continue
        full = np.zeros(n)
        full[k] = np.maximum(x[:-1], 0)
        slack = gram @ full - right + x[-1]
        slack[active] = 0
        if slack.min() < -1e-9:
            active[np.argmin(slack)] = True
            continue
        return full / full.sum()
    return w


#: Donor series that one synthetic control may use, and placebos.
_DONORS, _PLACEBOS = 5000, 100


def _synthetic(engine, relation, unit, period, given):
    """The panel, the number of donors, and a row for each treated unit with its fit and the placebos' ratios for its period.

    Treated units stay in Spark; only the donors' series, at most ``_DONORS``, come to the driver and go to each task.
    """
    spec = Spec.of(engine.config, **given)
    if spec.covariates:
        raise CausalError("synthetic control takes no covariates")
    panel = Panel(engine, relation, unit, period, spec, covariates=False)
    n = len(panel.periods)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p", "y"))), lambda v: v["y"]).alias("y")
    series = panel.rows.groupBy("unit").agg(F.first("first").alias("g"), lines).filter(F.size("y") == n)
    donors = series.filter("g is null").orderBy("unit").limit(_DONORS + 1).collect()
    if len(donors) > _DONORS:
        raise CausalError(f"more than {_DONORS} donors: narrow the relation to comparable units")
    treated = series.filter("g >= 2").select("unit", "g", F.lit(None).cast("int").alias("j"), "y")
    if len(donors) < 2:
        raise CausalError("synthetic control needs at least two complete units that are never treated: no donors")
    starts = [r[0] for r in treated.select("g").distinct().orderBy("g").collect()]  # at most one a period
    if not starts:
        raise CausalError("no complete unit starts treatment in the third period or later")
    names = [r["unit"] for r in donors]
    shared = engine.spark.sparkContext.broadcast((names, np.stack([r["y"] for r in donors], 1)))  # at most _DONORS series
    order = np.argsort(uniform(np.arange(len(names)), spec.seed, 31))[:_PLACEBOS]
    placebos = engine.table([(names[j], g, int(j), None) for g in starts for j in order], "unit string, g int, j int, y array<double>")

    def fit(batches):
        names, pool = shared.value
        for pdf in batches:
            rows = []
            for u, g, j, y in zip(pdf["unit"], pdf["g"], pdf["j"], pdf["y"], strict=True):
                own, g = pd.isna(j), int(g)
                y = np.array(y) if own else pool[:, int(j)]
                keep = np.arange(pool.shape[1]) != (-1 if own else int(j))
                w = np.zeros(pool.shape[1])
                w[keep] = simplex_weights(pool[:g, keep], y[:g])
                gap = y - pool @ w
                pre, post = np.sqrt(np.mean(gap[:g] ** 2)), np.sqrt(np.mean(gap[g:] ** 2))
                used = [k for k in np.argsort(-w, kind="stable").tolist() if own and w[k] > 1e-4]
                rows.append((u, g, bool(own), [names[k] for k in used], w[used].tolist(), pre, post, post / max(pre, 1e-12), gap[g:].mean(), y.tolist() if own else [], (y - gap).tolist() if own else []))
            yield pd.DataFrame(rows, columns=["unit", "g", "own", "donors", "w", "pre", "post", "ratio", "effect", "actual", "synthetic"])

    tasks = max(64, int(engine.spark.conf.get("spark.sql.shuffle.partitions")))
    todo = treated.unionByName(placebos).repartition(tasks, "unit", "g", "j")
    fitted = "unit string, g int, own boolean, donors array<string>, w array<double>, pre double, post double, ratio double, effect double, actual array<double>, synthetic array<double>"
    done = stored(todo.mapInPandas(fit, fitted), "synth")
    others = done.filter("not own").groupBy("g").agg(F.collect_list("ratio").alias("others"))  # at most _PLACEBOS a period
    return panel, len(names), done.filter("own").join(F.broadcast(others), "g", "left")


def _labels(panel):
    return F.array(*(F.lit(str(p)) for p in panel.periods))


def do_synth(engine, relation, unit: str = "", period: str = "", **given):
    """A synthetic control for each treated unit, judged against placebos."""
    panel, donors, own = _synthetic(engine, relation, unit, period, given)
    others = F.coalesce("others", F.array().cast("array<double>"))
    few = F.array(F.lit("fewer than 20 placebos: the p value is coarse"))
    return own.orderBy("unit").select(
        "unit", _labels(panel)[F.col("g")].alias("adoption_period"), F.lit("ATT").alias("estimand"), F.lit("synthetic control").alias("estimator"),
        F.col("effect").alias("estimate"), F.col("pre").alias("pre_rmspe"), F.col("post").alias("post_rmspe"), F.col("ratio").alias("rmspe_ratio"),
        ((F.size(F.filter(others, lambda x: x >= F.col("ratio"))) + 1) / (F.size(others) + 1)).alias("p_value"),
        F.lit(donors).cast("long").alias("n_donors"), F.col("g").cast("long").alias("n_pre_periods"), (F.lit(len(panel.periods)) - F.col("g")).cast("long").alias("n_post_periods"),
        F.map_from_arrays("donors", "w").alias("weights"), F.when(F.size(others) < 20, few).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def do_synth_path(engine, relation, unit: str = "", period: str = "", **given):
    """Actual and synthetic outcomes of each treated unit by period."""
    panel, _, own = _synthetic(engine, relation, unit, period, given)
    steps = own.select("unit", "g", F.posexplode(F.arrays_zip("actual", "synthetic")).alias("t", "v")).orderBy("unit", "t")
    return steps.select(
        "unit", _labels(panel)[F.col("t")].alias("period"), (F.col("t") - F.col("g")).cast("long").alias("relative_period"), F.col("v.actual").alias("actual"),
        F.col("v.synthetic").alias("synthetic"), (F.col("v.actual") - F.col("v.synthetic")).alias("gap"), (F.col("t") < F.col("g")).alias("is_pre_treatment"),
    )
