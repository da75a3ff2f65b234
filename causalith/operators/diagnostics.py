"""Checks of an effect's assumptions: balance, overlap, refutations, sensitivity, and what the frame holds."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..errors import CausalError
from ..functions.draws import normal, poisson, uniform
from ..functions.special import Z95
from ..plans.frame import Frame, Spec, build
from ..plans.rows import SparkRows
from .effects import chosen
from .nuisance import estimate, propensity


def _weighted(frame: Frame):
    """Standardised differences of each feature, raw and weighted by inverse propensities."""
    rows = propensity(frame.rows, frame.folds).keep()

    def sums(c):
        t, x = c["_t"], c["X"]
        out = {}
        for name, w in (("raw", np.ones(len(t))), ("weighted", np.where(t == 1, 1 / c["_e"], 1 / (1 - c["_e"])))):
            out[name] = np.stack([np.vstack([np.full(x.shape[1], (w * m).sum()), (x * (w * m)[:, None]).sum(0), (x * x * (w * m)[:, None]).sum(0)]) for m in (1 - t, t)])
        return out

    s = rows.sum(sums)
    out = []
    for j in range(frame.width):
        part = {}
        for name, v in s.items():
            mean = v[:, 1, j] / v[:, 0, j]
            var = v[:, 2, j] / v[:, 0, j] - mean**2
            part[name] = ((mean[1] - mean[0]) / math.sqrt(max(var.sum() / 2, 1e-12)), var[1] / var[0] if var[0] > 1e-12 else 0.0)
        out.append((part["raw"][0], part["weighted"][0], part["raw"][1]))
    return rows, out


def do_balance(engine, relation, **given):
    """Standardised mean differences of each feature, raw and weighted."""
    frame = build(engine, relation, Spec.of(engine.config, **given), outcome=bool(given.get("outcome")))
    if not frame.width:
        return engine.table([], "covariate string, feature string, smd_raw double, smd_weighted double, variance_ratio double, balanced boolean")
    _, found = _weighted(frame)
    rows = [(f.source, f.name, float(a), float(b), float(r), bool(abs(b) < 0.1)) for f, (a, b, r) in zip(frame.features, found, strict=True)]
    return engine.table(rows, "covariate string, feature string, smd_raw double, smd_weighted double, variance_ratio double, balanced boolean")


def do_overlap(engine, relation, **given):
    """Rows of each arm in ten buckets of the propensity."""
    frame = build(engine, relation, Spec.of(engine.config, **given), outcome=bool(given.get("outcome")))
    rows = propensity(frame.rows, frame.folds)
    bucket = F.least(F.floor(F.col("_e") * 10), F.lit(9)).cast("int")
    counts = rows.df.groupBy(bucket.alias("bucket")).agg(F.sum("_t").alias("t"), F.sum(1 - F.col("_t")).alias("c"))
    every = engine.spark.range(10).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(F.broadcast(counts), "bucket", "left")  # ten rows
    t, c = (F.coalesce(F.col(k), F.lit(0.0)).cast("long") for k in ("t", "c"))
    return out.select("bucket", (F.col("bucket") / 10).alias("ps_low"), ((F.col("bucket") + 1) / 10).alias("ps_high"), t.alias("n_treated"), c.alias("n_control"), ((t == 0) != (c == 0)).alias("off_support")).orderBy("bucket")


CHECK = "check_name string, status string, detail string, severity string"


def do_diagnose(engine, relation, **given):
    """One row for each check of the data an effect would rest on."""
    spec = Spec.of(engine.config, **given)
    frame = build(engine, relation, spec, outcome=bool(spec.outcome))
    out = []

    def say(name, level, detail):
        out.append((name, {"ok": "pass", "warning": "warn", "critical": "fail"}[level], detail, {"ok": "info", "warning": "warning", "critical": "critical"}[level]))

    size, what = (frame.clusters, "clusters") if frame.clustered else (frame.n, "rows")
    say("sample_size", "ok" if size >= 200 else "warning", f"{size} {what}")
    share = frame.n_treated / frame.n
    say("treatment_prevalence", "ok" if 0.05 <= share <= 0.95 else "warning", f"{share:.1%} treated")
    if frame.width:
        rows, found = _weighted(frame)
    else:
        rows, found = propensity(frame.rows, frame.folds), []
    extreme = rows.sum(lambda c: {"s": np.array([((c["_e"] < spec.trim) | (c["_e"] > 1 - spec.trim)).sum()])})["s"][0] / frame.n
    say("positivity", "ok" if extreme < 0.05 else "warning" if extreme < 0.2 else "critical", f"{extreme:.1%} of rows have a propensity outside [{spec.trim:g}, {1 - spec.trim:g}]")
    if found:
        j = max(range(len(found)), key=lambda j: abs(found[j][1]))
        worst = abs(found[j][1])
        say("balance", "ok" if worst < 0.1 else "warning" if worst < 0.25 else "critical", f'worst weighted difference {worst:.3f}, of "{frame.features[j].name}"')
    if spec.outcome:
        s = frame.rows.df.agg(F.stddev_samp("_y")).first()[0] or 0.0
        say("outcome_variation", "ok" if s > 1e-9 else "critical", f"standard deviation {s:.6g}")
    say("missing_data", "ok" if not frame.n_missing else "warning", f"{frame.n_missing} of {frame.n} rows have a missing covariate")
    per = frame.n / max(1, frame.width)
    say("dimensionality", "ok" if per >= 20 else "warning", f"{frame.width} features, {per:.0f} rows each")
    for w in frame.warnings:
        say("encoding", "warning", w)
    return engine.table(out, CHECK)


def _again(frame: Frame, rows, spec: Spec, name: str, reps: int = 200):
    return estimate(rows, estimand="ATE", estimator=name, n=frame.n, n_treated=frame.n_treated, folds=frame.folds, binary=frame.binary_outcome, trim=spec.trim, reps=reps, seed=spec.seed, clustered=frame.clustered)


def _unit(c) -> np.ndarray:
    """The key that draws are made for: the cluster's where there are clusters."""
    return c["_key"]


METHODS = ("placebo_treatment", "random_common_cause", "subset", "bootstrap", "unobserved_confounder")


def do_refute(engine, relation, method: str = "placebo_treatment", fraction: float = 0.8, strength: float = 0.5, **given):
    """The effect estimated again after a change that it should survive, or vanish under."""
    if method not in METHODS:
        raise CausalError(f'unknown method "{method}"; use one of {", ".join(METHODS)}')
    spec = Spec.of(engine.config, **given)
    name = chosen(engine, spec)
    frame = build(engine, relation, spec)
    first = _again(frame, frame.rows, spec, name)
    rows, seed, target = frame.rows, spec.seed, first.estimate
    if method == "placebo_treatment":
        share = frame.n_treated / frame.n
        # A treatment drawn for each unit with the same share is exchangeable with a permuted one.
        rows = rows.append(lambda c: [(uniform(_unit(c), seed, 11) < share).astype(float)], ["_t"]).keep()
        target = 0.0
    elif method == "random_common_cause":
        p = frame.width
        rows = SparkRows(rows.append(lambda c: [normal(_unit(c), seed, 12)], [f"x{p}"]).df, p + 1).keep()
    elif method == "subset":
        rows = rows.append(lambda c: [(uniform(_unit(c), seed, 13) < fraction).astype(float)], ["_take"]).filter("_take = 1").keep()
    elif method == "bootstrap":
        df = rows.append(lambda c: [poisson(_unit(c), seed, 14)], ["_take"]).df
        copies = F.explode(F.sequence(F.lit(1), F.col("_take").cast("int")))
        rows = SparkRows(df.filter("_take > 0").withColumn("_copy", copies).drop("_copy", "_take"), frame.width).keep()
    else:
        m, s = (frame.rows.df.agg(F.avg("_y"), F.stddev_samp("_y")).first())
        p = frame.width
        made = lambda c: [strength * (2 * c["_t"] - 1) + strength * (c["_y"] - m) / max(s or 0.0, 1e-12) + normal(_unit(c), seed, 15)]
        rows = SparkRows(rows.append(made, [f"x{p}"]).df, p + 1).keep()
    stats = rows.sum(lambda c: {"s": np.array([len(c["_t"]), c["_t"].sum()])})["s"]
    second = _again(replace(frame, n=int(stats[0]), n_treated=int(stats[1]), rows=rows), rows, spec, name)
    se = second.std_error if method == "placebo_treatment" else first.std_error
    tolerance, difference = 2 * se, second.estimate - target
    detail = {"placebo_treatment": "a random treatment should have no effect", "random_common_cause": "a random covariate should not matter", "subset": f"{fraction:g} of the units", "bootstrap": "a resample of the units", "unobserved_confounder": f"a confounder of strength {strength:g} was made up"}[method]
    return engine.table([(method, first.estimate, second.estimate, difference, tolerance, bool(abs(difference) <= tolerance), detail)], "method string, original_estimate double, refuted_estimate double, difference double, tolerance double, passed boolean, detail string")


def _e_value(ratio: float) -> float:
    r = max(ratio, 1 / ratio)
    return r + math.sqrt(r * (r - 1))


def do_sensitivity(engine, relation, **given):
    """How strong an unobserved confounder must be: robustness values and E-values of the dml estimate."""
    spec = Spec.of(engine.config, **given)
    frame = build(engine, relation, spec)
    e = _again(frame, frame.rows, spec, "dml")
    dof = max(1, frame.n - frame.width - 2)
    t = e.estimate / e.std_error if e.std_error > 0 else 0.0

    def robustness(t):
        f = abs(t) / math.sqrt(dof)
        return 0.5 * (math.sqrt(f**4 + 4 * f * f) - f * f)

    rv, rv_ci = robustness(t), robustness(max(abs(t) - Z95, 0))
    _, low, high, _ = e.bounds()
    sd = frame.rows.df.agg(F.stddev_samp("_y")).first()[0] or 1.0
    ratio = (lambda v: math.exp(v)) if frame.binary_outcome else (lambda v: math.exp(0.91 * v / max(sd, 1e-12)))
    near = 0.0 if low <= 0 <= high else (low if low > 0 else high)
    ev, ev_ci = _e_value(ratio(e.estimate)), 1.0 if near == 0 else _e_value(ratio(near))
    text = f"a confounder that explains {rv:.1%} of the rest of both treatment and outcome would take the estimate to zero, {rv_ci:.1%} its significance"
    return engine.table([(e.estimate, e.std_error, rv, rv_ci, ev, ev_ci, text)], "estimate double, std_error double, robustness_value double, robustness_value_ci double, e_value double, e_value_ci double, interpretation string")


def do_frame_summary(engine, relation, **given):
    """What the frame makes of a relation: one row for each feature."""
    given.pop("cluster", None)
    frame = build(engine, relation, Spec.of(engine.config, **given), outcome=bool(given.get("outcome")))
    tail = (frame.n, frame.width, frame.n_treated, frame.n_missing, frame.treated_label, frame.control_label, frame.warnings)
    rows = [(f.name, f.source, f.kind, f.level, float(f.center), float(f.scale), *tail) for f in frame.features] or [("no covariates", None, None, None, None, None, *tail)]
    return engine.table(rows, "feature string, source string, kind string, level string, center double, scale double, n long, n_features long, n_treated long, n_rows_with_missing long, treated_label string, control_label string, warnings array<string>")
