"""Treatments that change over time: marginal structural models and regimes' restricted mean survival."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CausalError
from ..functions.draws import poisson
from ..functions.models import fit_logistic, fit_ridge, penalty, predict, sandwich
from ..functions.special import interval
from ..plans.frame import as_double, column, order_statistics
from ..plans.rows import SparkRows
from ..plans.storage import stored
from ..sources.relation import resolve
from .identification import _spread


def _load(engine, relation, unit, period, treatment, outcome, covariates):
    """Rows ``unit, p, a, prior, y, l0..`` of a long panel, and its periods."""
    if not (unit and period and treatment and outcome):
        raise CausalError("unit, period, treatment and an outcome or event are required")
    df = resolve(engine.spark, relation)
    unit, period, treatment, outcome = (column(df, c) for c in (unit, period, treatment, outcome))
    covariates = [column(df, c) for c in covariates or []]
    base = df.select(F.col(f"`{unit}`").cast("string").alias("unit"), F.col(f"`{period}`").alias("period"), F.coalesce(as_double(df, treatment), F.lit(0.0)).alias("a"), as_double(df, outcome).alias("y"), *(F.coalesce(as_double(df, c), F.lit(0.0)).alias(f"l{i}") for i, c in enumerate(covariates))).filter("unit is not null and period is not null")
    periods = [r[0] for r in base.select("period").distinct().orderBy("period").limit(10_001).collect()]
    if len(periods) < 2:
        raise CausalError("the panel needs at least two periods")
    index = engine.spark.createDataFrame([(p, float(i)) for i, p in enumerate(periods)], T.StructType([base.schema["period"], T.StructField("p", T.DoubleType())]))
    by = Window.partitionBy("unit").orderBy("p")
    rows = base.join(F.broadcast(index), "period").drop("period").withColumn("prior", F.coalesce(F.lag("a").over(by), F.lit(0.0)))  # one row a period
    rows = stored(rows.withColumn("_key", F.xxhash64("unit")), "long")
    odd = rows.filter("a not in (0.0, 1.0)").limit(1).count()
    if odd:
        raise CausalError("the treatment must be 0 or 1 in every period")
    units = rows.select("unit").distinct().count()
    if units < 20:
        raise CausalError(f"only {units} units; at least 20 are needed")
    varies = rows.agg(F.min("a"), F.max("a")).first()
    if varies[0] == varies[1]:
        raise CausalError("the treatment never varies")
    return rows, periods, units, covariates


def _likelihood(c, x, beta):
    p = predict(x, beta, True)
    return np.where(c["a"] == 1, p, 1 - p)


MSM = "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, n_units long, n_periods long, mean_weight double, max_weight double, effective_n double, warnings array<string>"


def do_msm(engine, relation, unit="", period="", treatment="", outcome="", covariates=None, baseline=None, truncate: float = 0.0, model: str = "cumulative", **_):
    """A marginal structural model fitted with stabilised inverse-probability weights."""
    if model not in ("cumulative", "by_period", "saturated"):
        raise CausalError(f'unknown model "{model}"; use cumulative, by_period or saturated')
    rows, periods, n_units, names = _load(engine, relation, unit, period, treatment, outcome, covariates)
    n, warnings = len(periods), []
    if model == "saturated" and n > 6:
        raise CausalError("the saturated model is for at most 6 periods")
    lower = [c.lower() for c in names]
    for b in baseline or []:
        if b.lower() not in lower:
            raise CausalError(f'the baseline "{b}" must be one of the covariates')
    own = [lower.index(b.lower()) for b in baseline or []]
    data = SparkRows(rows, 0).keep()
    den = lambda c: np.stack([c["p"], c["prior"], *(c[f"l{i}"] for i in range(len(names)))], 1)
    num = lambda c: np.stack([c["p"], c["prior"], *(c[f"l{i}"] for i in own)], 1)
    total = rows.count()
    model_of = lambda c: (np.ones(len(c["a"])), c["a"])
    (bd,) = fit_logistic(data, den, [model_of], ridge=penalty(total), steps=60, least=0.0)
    (bn,) = fit_logistic(data, num, [model_of], ridge=penalty(total), steps=60, least=0.0)
    rated = data.append(lambda c: [_likelihood(c, num(c), bn) / np.maximum(_likelihood(c, den(c), bd), 1e-6)], ["ratio"]).df
    wide = [F.max(F.when(F.col("p") == k, F.col("a"))).alias(f"a{k}") for k in range(n)] if model != "cumulative" else []
    units = rated.groupBy("unit").agg(F.product("ratio").alias("w"), F.sum("a").alias("total"), F.max_by("y", F.when(F.col("y").isNotNull(), F.col("p"))).alias("y"), *wide).filter("y is not null")
    units = stored(units, "units")
    kept = units.count()
    if kept < n_units:
        warnings.append(f"{n_units - kept} units have no outcome")
    w = F.col("w")
    if truncate and truncate > 0:
        low, high = order_statistics(units, w, [int(truncate * (kept - 1)), int((1 - truncate) * (kept - 1))])
        units = units.withColumn("w", F.greatest(F.lit(low), F.least(w, F.lit(high))))
    s = units.agg(F.avg("w").alias("mean"), F.max("w").alias("max"), F.sum("w").alias("w"), F.sum(w * w).alias("ww")).first()
    tail = (kept, n, s["mean"], s["max"], s["w"] ** 2 / s["ww"])
    if s["max"] > 20:
        warnings.append(f"the largest weight is {s['max']:.1f}: consider truncate")
    flat = SparkRows(units, 0).keep()
    weighted = lambda c: (c["w"], c["y"])

    def fit(features):
        (b,) = fit_ridge(flat, features, [weighted], ridge=1e-8)
        return b, sandwich(flat, features, weighted, b, 1e-8, False)

    out = []

    def say(name, est, var):
        se, low, high, _ = interval(float(est), float(np.sqrt(max(var, 0))))
        out.append((name, "msm-iptw", float(est), se, low, high, *tail, warnings))

    if model == "cumulative":
        b, v = fit(lambda c: c["total"][:, None])
        say("effect per treated period", b[1], v[1, 1])
        return engine.table(out, MSM)
    # A period that a unit lacks has no treatment: it gets a mark or a history of its own, so that no contrast rests on it.
    unseen = [F.col(f"a{k}").isNull() for k in range(n)]
    look = units.agg(*(f(f"a{k}").alias(f"{n_}{k}") for k in range(n) for n_, f in (("l", F.min), ("h", F.max))), *(F.sum(u.cast("long")).alias(f"u{k}") for k, u in enumerate(unseen)), F.sum(reduce(or_, unseen).cast("long")).alias("short")).first()
    if look["short"]:
        warnings.append(f"{look['short']} units lack a period: no treatment is assumed there")
    if model == "by_period":
        for k in range(n):
            if look[f"l{k}"] == look[f"h{k}"]:
                raise CausalError(f"the treatment does not vary in period {periods[k]}")
        partly = [k for k in range(n) if look[f"u{k}"]]
        b, v = fit(lambda c: np.stack([*(np.nan_to_num(c[f"a{k}"]) for k in range(n)), *(np.isnan(c[f"a{k}"]).astype(float) for k in partly)], 1))
        for k in range(n):
            say(f"treated in period {periods[k]}", b[k + 1], v[k + 1, k + 1])
        say("always vs never treated", b[1 : n + 1].sum(), v[1 : n + 1, 1 : n + 1].sum())
        return engine.table(out, MSM)
    code = sum((F.coalesce(F.col(f"a{k}") * 2**k, F.lit(float(2 ** (n + k)))) for k in range(n)), F.lit(0.0))
    flat = SparkRows(units.withColumn("code", code), 0).keep()
    counts = {int(r[0]): r[1] for r in flat.df.groupBy("code").count().collect()}
    if not counts.get(0):
        raise CausalError("no unit is never treated")
    codes = sorted(k for k in counts if k)
    missing = 2**n - sum(k < 2**n for k in counts)
    if missing:
        warnings.append(f"{missing} histories do not occur")
    if any(counts[k] < 10 for k in codes):
        warnings.append("some histories have fewer than 10 units")
    b, v = fit(lambda c: np.stack([(c["code"] == k).astype(float) for k in codes], 1))
    for i, k in enumerate(codes):
        say("".join("?" if k >> n + t & 1 else "1" if k >> t & 1 else "0" for t in range(n)) + " vs never", b[i + 1], v[i + 1, i + 1])
    return engine.table(out, MSM)


def _followed(rows: DataFrame) -> DataFrame:
    """With ``same``: 1 while a unit has had one treatment throughout, so that it follows a regime."""
    by = Window.partitionBy("unit").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("same", (F.min("a").over(by) == F.max("a").over(by)).cast("double"))


def do_msm_rmst(engine, relation, unit="", period="", treatment="", event="", covariates=None, horizon: int | None = None, bootstrap_reps: int | None = None, seed: int | None = None, **_):
    """Event-free periods under always against never treating, with weights for treatment and dropout."""
    rows, periods, n_units, names = _load(engine, relation, unit, period, treatment, event, covariates)
    n = len(periods)
    by = Window.partitionBy("unit").orderBy("p")
    rows = rows.withColumn("k", F.row_number().over(by) - 1).withColumn("later", F.lead("y").over(by))
    look = rows.agg(F.sum((F.col("k") != F.col("p")).cast("long")).alias("gap"), F.sum((F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0)).cast("long")).alias("odd"), F.sum(((F.col("y") == 1) & F.col("later").isNotNull()).cast("long")).alias("after"), F.sum("y").alias("events")).first()
    if look["odd"]:
        raise CausalError("event must be 0 or 1 in every row")
    if look["after"]:
        raise CausalError("rows follow a unit's event; they must end with it")
    if look["gap"]:
        raise CausalError("some unit has a gap: its rows must fill all periods from the first one on")
    if not look["events"]:
        raise CausalError("no unit has an event")
    last = F.col("later").isNull()
    dropped = last & (F.col("y") == 0) & (F.col("p") < n - 1)
    rows = _followed(rows).withColumn("drop", dropped.cast("double")).withColumn("stays", ((F.col("y") == 0) & (F.col("p") < n - 1)).cast("double")).drop("later", "k")
    rows = stored(rows, "regimes")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("drop").alias("d")).first()
    data = SparkRows(rows, 0).keep()
    lam = penalty(count["n"])
    extra = [f"l{i}" for i in range(len(names))]
    den = lambda c: np.stack([c["p"], c["prior"], *(c[x] for x in extra)], 1)
    out_of = lambda c: np.stack([c["p"], c["a"], *(c[x] for x in extra)], 1)
    seed = int(seed) if seed and int(seed) > 0 else engine.config.seed
    reps = engine.config.bootstrap_reps if bootstrap_reps is None else max(0, int(bootstrap_reps))
    draw = lambda c, r: np.ones(len(c["a"])) if r < 0 else poisson(c["_key"], seed, r)
    hazards, top, seen = [], 0.0, None
    for first in range(-1, reps, 20):
        some = list(range(first, min(reps, first + 20)))
        bd = fit_logistic(data, den, [lambda c, r=r: (draw(c, r), c["a"]) for r in some], ridge=lam, steps=60, least=0.0)
        bc = fit_logistic(data, out_of, [lambda c, r=r: (draw(c, r) * c["stays"], c["drop"]) for r in some], ridge=lam, steps=60, least=0.0) if count["d"] else None

        def factors(c, some=some, bd=bd, bc=bc):
            res = []
            for i in range(len(some)):
                res.append(np.log(np.maximum(_likelihood(c, den(c), bd[i]), 1e-6)))
                stay = np.where(c["stays"] == 1, 1 - predict(out_of(c), bc[i], True), 1.0) if bc is not None else np.ones(len(c["a"]))
                res.append(np.log(np.maximum(stay, 1e-6)))
            return res

        cols = [x for i in range(len(some)) for x in (f"f{i}", f"s{i}")]
        logs = data.append(factors, cols).df
        run = by.rowsBetween(Window.unboundedPreceding, 0)
        prior = by.rowsBetween(Window.unboundedPreceding, -1)
        weight = [F.exp(-(F.sum(f"f{i}").over(run) + F.coalesce(F.sum(f"s{i}").over(prior), F.lit(0.0)))).alias(f"w{i}") for i in range(len(some))]
        followed = SparkRows(logs.select("unit", "_key", "p", "a", "y", "same", *weight).filter("same = 1"), 0)

        def sums(c, some=some):
            res = np.zeros((len(some), 2, n, 3))
            p = c["p"].astype(int)
            for i, r in enumerate(some):
                w = c[f"w{i}"] * draw(c, r)
                for a in (0, 1):
                    m = c["a"] == a
                    res[i, a, :, 0] = np.bincount(p[m], w[m], n)
                    res[i, a, :, 1] = np.bincount(p[m], (w * c["y"])[m], n)
                    res[i, a, :, 2] = np.bincount(p[m], None, n)
            return {"s": res}

        v = followed.sum(sums)["s"]
        if seen is None:
            seen = v[0, :, :, 2]
            top = followed.df.agg(F.max("w0")).first()[0]
        with np.errstate(all="ignore"):
            hazards.append(np.where(v[..., 0] > 0, v[..., 1] / v[..., 0], 0))
    h = np.concatenate(hazards)
    enough = max(10, n_units // 20)
    if horizon is None:
        good = [t for t in range(n) if (seen[:, t] >= enough).all()]
        if not good:
            raise CausalError("too few units follow either regime")
        horizon = max(good) + 1
    horizon = int(horizon)
    if not 1 <= horizon <= n:
        raise CausalError(f"the horizon must be between 1 and {n} periods")
    surv = np.cumprod(1 - h[:, :, :horizon], 2)
    rmst = surv.sum(2)
    diff = rmst[:, 1] - rmst[:, 0]
    se, low, high = _spread(float(diff[0]), diff[1:].tolist()) if reps else (None, None, None)
    warnings = []
    if top and top > 50:
        warnings.append(f"the largest weight is {top:.1f}")
    if (seen[:, :horizon] < 10).any():
        warnings.append("fewer than 10 units follow a regime to the horizon")
    row = ("RMST difference", "iptw-ipcw-regime-kaplan-meier", float(diff[0]), se, low, high, horizon, rmst[0, 1], rmst[0, 0], surv[0, 1, -1], surv[0, 0, -1], n_units, n, int(look["events"]), int(count["d"] or 0), int(seen[1, horizon - 1]), int(seen[0, horizon - 1]), float(top or 0), warnings)
    return engine.table([row], "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, horizon long, rmst_always double, rmst_never double, survival_always double, survival_never double, n_units long, n_periods long, n_events long, n_dropouts long, followers_always long, followers_never long, max_weight double, warnings array<string>")
