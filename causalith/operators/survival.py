"""Restricted mean survival time and time lost to a cause, by weighted Kaplan-Meier and Aalen-Johansen curves.

Rows are sorted by their durations across partitions. One pass gives the weights that leave in each partition, so that each
knows who is at risk at its start; a second lets every partition integrate its own stretch of the curves, for the estimate
and all bootstrap samples at once, and the driver chains the stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import CausalError
from ..functions.draws import poisson
from ..functions.models import fit_logistic, penalty, predict
from ..functions.special import interval
from ..plans.frame import Spec, build, order_statistics
from ..plans.rows import SparkRows, _columns
from .identification import _spread
from .nuisance import X


#: Rows of a sorted partition, as far as equal durations allow.
_ROWS = 1_000_000


def _stretch(times, arm_weights, event_weights, cause_weights, state):
    """Advance curves over rows sorted by time. ``state`` holds at-risk weights, survival, incidence, areas, and the last time."""
    risk, surv, inc, area_s, area_i, last, horizon = state
    new = np.flatnonzero(np.concatenate([[True], times[1:] != times[:-1]]))
    leaving = np.add.reduceat(arm_weights, new, axis=0)
    d = np.add.reduceat(event_weights, new, axis=0)
    dk = np.add.reduceat(cause_weights, new, axis=0)
    t = times[new]
    before = risk - (np.cumsum(leaving, 0) - leaving)
    ok = before > 1e-12
    safe = np.where(ok, before, 1)
    inside = (t <= horizon)[:, None]
    factor = np.where(ok & inside, np.maximum(1 - d / safe, 0), 1)
    after = surv * np.cumprod(factor, 0)
    prior = np.vstack([surv[None], after[:-1]])
    gain = np.where(ok & inside, prior * dk / safe, 0)
    inc_after = inc + np.cumsum(gain, 0)
    inc_prior = np.vstack([inc[None], inc_after[:-1]])
    edge = np.minimum(np.concatenate([[last], t]), horizon)
    step = np.diff(edge)[:, None]
    return risk - leaving.sum(0), after[-1], inc_after[-1], area_s + (prior * step).sum(0), area_i + (inc_prior * step).sum(0), t[-1], horizon


def _curves(ordered, width: int, weights, arms_reps: int, cause: int, horizon: float):
    """Areas under survival and incidence up to the horizon, and both curves there, for each column of ``weights``; rows are in the order of ``_y``."""

    def leaving(batches):
        from pyspark import TaskContext

        total, first = np.zeros(arms_reps), None
        for batch in batches:
            if batch.num_rows:
                c = _columns(batch, width)
                first = c["_y"][0] if first is None else first
                total += weights(c).sum(0)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["part", "v"])

    sums = {r[0]: np.array(r[1]) for r in ordered.mapInArrow(leaving, "part int, v array<double>").collect()}
    every = sum(sums.values())
    at_start, gone = {}, np.zeros(arms_reps)
    for p in sorted(sums):
        at_start[p] = every - gone
        gone = gone + sums[p]

    def integrate(batches):
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        if p not in at_start:
            return
        one, zero = np.ones(arms_reps), np.zeros(arms_reps)
        state, held, first = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _columns(batch, width)
            w = weights(c)
            event = (c["_aux"] >= 0.5)[:, None]
            rows = [c["_y"], w, w * event, w * (np.round(c["_aux"]) == cause)[:, None]]
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            if state is None:
                first = rows[0][0]
                state = (at_start[p], one, zero, zero, zero, first, horizon)
            # Rows with the batch's last time wait for the next one, summed up.
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                state = _stretch(*(r[:cut] for r in rows), state)
            held = [rows[0][cut : cut + 1], *(r[cut:].sum(0, keepdims=True) for r in rows[1:])]
        state = _stretch(*held, state)
        _, s, i, a, b, last, _ = state
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([first]), pa.array([last]), pa.array([np.stack([s, i, a, b]).ravel()], pa.list_(pa.float64()))], ["part", "first", "last", "v"])

    parts = sorted(ordered.mapInArrow(integrate, "part int, first double, last double, v array<double>").collect(), key=lambda r: r["part"])
    surv, inc, area_s, area_i, last = np.ones(arms_reps), np.zeros(arms_reps), np.zeros(arms_reps), np.zeros(arms_reps), 0.0
    for r in parts:
        s, i, a, b = np.array(r["v"]).reshape(4, -1)
        gap = max(0.0, min(r["first"], horizon) - min(last, horizon))
        length = max(0.0, min(r["last"], horizon) - min(r["first"], horizon))
        area_s = area_s + surv * (gap + a)
        area_i = area_i + inc * (gap + length) + surv * b
        inc = inc + surv * i
        surv = surv * s
        last = r["last"]
    rest = max(0.0, horizon - min(last, horizon))
    return area_s + surv * rest, area_i + inc * rest, surv, inc


def _survival(engine, relation, duration, event, cause, horizon, given):
    if not duration or not event:
        raise CausalError("duration and event are required")
    spec = Spec.of(engine.config, **given, outcome=duration, event=event)
    frame = build(engine, relation, spec)
    rows, warnings = frame.rows, list(frame.warnings)
    look = rows.df.agg(F.min("_y").alias("low"), F.max("_y").alias("high"), F.max(F.abs(F.col("_aux") - F.round("_aux"))).alias("odd"), F.min("_aux").alias("least"), F.max("_aux").alias("most"), *(F.sum(((F.col("_t") == a) & (F.col("_aux") >= 0.5)).cast("long")).alias(f"e{a}") for a in (0, 1)), *(F.sum(((F.col("_t") == a) & (F.round("_aux") == (cause or 1))).cast("long")).alias(f"c{a}") for a in (0, 1)), *(F.max(F.when(F.col("_t") == a, F.col("_y"))).alias(f"m{a}") for a in (0, 1))).first()
    if look["low"] < 0:
        raise CausalError("durations must not be negative")
    if cause is not None:
        if look["odd"] > 0 or look["least"] < 0:
            raise CausalError("event codes must be whole numbers, 0 for censored")
        if not look["c0"] or not look["c1"]:
            raise CausalError(f"each arm needs an event of cause {cause}")
    elif not look["e0"] or not look["e1"]:
        raise CausalError("each arm needs an observed event")
    if cause is None and look["most"] > 1:
        warnings.append("event has codes above 1: all count as the event; do_rmtl tells causes apart")
    if horizon is None:
        found = []
        for a, n in ((0, frame.n - frame.n_treated), (1, frame.n_treated)):
            k = max(10, n // 20)
            found.append(order_statistics(rows.df.filter(F.col("_t") == a), F.col("_y"), [max(0, n - k - 1)])[0])
        horizon = min(found)
    horizon = float(horizon)
    if horizon <= 0:
        raise CausalError("the horizon must be positive")
    if horizon > min(look["m0"], look["m1"]):
        warnings.append("the horizon lies beyond an arm's last follow-up: its curve is carried on flat")
    reps = max(spec.bootstrap_reps, 100)
    seed, trim = spec.seed, spec.trim
    draw = lambda c, r: np.ones(len(c["_t"])) if r < 0 else poisson(c["_key"], seed, r)
    results = []
    # One sort for all samples; equal durations share a partition, and the partitions' number grows with the rows.
    parts = max(engine.spark.sparkContext.defaultParallelism, frame.n // _ROWS)
    rows = SparkRows(rows.df.repartitionByRange(parts, "_y").sortWithinPartitions("_y"), frame.width).keep()
    for first in range(-1, reps, 50):
        some = list(range(first, min(reps, first + 50)))
        betas = fit_logistic(rows, X, [lambda c, r=r: (draw(c, r), c["_t"]) for r in some], ridge=penalty(frame.n), steps=60, least=0.0)
        share = rows.sum(lambda c, some=some: {"s": np.array([[(w := draw(c, r)).sum(), (w * c["_t"]).sum()] for r in some])})["s"]

        def weights(c, some=some, betas=betas, share=share):
            out = np.zeros((len(c["_t"]), 2 * len(some)))
            for i, r in enumerate(some):
                e = np.clip(predict(c["X"], betas[i], True), trim, 1 - trim)
                p = share[i, 1] / share[i, 0]
                w = draw(c, r)
                out[:, 2 * i] = w * (c["_t"] == 0) * (1 - p) / (1 - e)
                out[:, 2 * i + 1] = w * (c["_t"] == 1) * p / e
            return out

        results.append(np.stack(_curves(rows.df, frame.width, weights, 2 * len(some), cause or 1, horizon)))
    v = np.concatenate([r.reshape(4, -1, 2) for r in results], axis=1)  # area, lost, survival, incidence; sample; arm
    which = 0 if cause is None else 1
    diff = v[which, :, 1] - v[which, :, 0]
    se, low, high = _spread(float(diff[0]), diff[1:].tolist())
    p = interval(float(diff[0]), se or 0.0)[3]
    events = look["e0"] + look["e1"]
    return frame, horizon, v, float(diff[0]), se, low, high, p, events, look, warnings


def do_rmst(engine, relation, duration: str = "", event: str = "", horizon: float | None = None, **given):
    """Difference in restricted mean survival time between the arms."""
    frame, h, v, est, se, low, high, p, events, _, warnings = _survival(engine, relation, duration, event, None, horizon, given)
    row = ("RMST difference", "iptw-kaplan-meier", est, se, low, high, p, h, v[0, 0, 1], v[0, 0, 0], frame.n, events, 1 - events / frame.n, warnings)
    return engine.table([row], "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, p_value double, horizon double, rmst_treated double, rmst_control double, n long, n_events long, censored_fraction double, warnings array<string>").drop("p_value")


def do_rmtl(engine, relation, duration: str = "", event: str = "", cause: int | None = None, horizon: float | None = None, **given):
    """Difference in restricted mean time lost to one of several causes."""
    if cause is None or int(cause) < 1:
        raise CausalError("cause is required: a positive event code")
    frame, h, v, est, se, low, high, _, events, look, warnings = _survival(engine, relation, duration, event, int(cause), horizon, given)
    own = look["c0"] + look["c1"]
    row = ("RMTL difference", "iptw-aalen-johansen", int(cause), est, se, low, high, h, v[1, 0, 1], v[1, 0, 0], v[3, 0, 1], v[3, 0, 0], frame.n, own, events - own, 1 - events / frame.n, warnings)
    return engine.table([row], "estimand string, estimator string, cause long, estimate double, std_error double, ci_low double, ci_high double, horizon double, rmtl_treated double, rmtl_control double, incidence_treated double, incidence_control double, n long, n_events long, n_competing long, censored_fraction double, warnings array<string>")
