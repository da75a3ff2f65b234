"""Average, conditional and grouped effects of a binary treatment, and pooling of effects across sites."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..errors import CausalError
from ..functions.special import chi_square_tail, interval
from ..plans.frame import Spec, as_double, build, column, is_number, levels_of, ranked
from ..plans.ordinals import local_folds, local_keys
from ..plans.rows import LocalRows
from ..plans.storage import stored
from ..sources.relation import resolve
from .nuisance import ESTIMATORS, cate, estimate, nuisance

EFFECT = "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, p_value double, n long, n_treated long, n_trimmed long, variance_method string, warnings array<string>"


def chosen(engine, spec: Spec) -> str:
    name = spec.estimator or engine.config.default_estimator
    if spec.model:
        from .models import refuse

        refuse(spec.model)
    if name not in ESTIMATORS:
        raise CausalError(f'unknown estimator "{name}"; use one of {", ".join(ESTIMATORS)}')
    return name


def effect(engine, relation, estimand: str, **given):
    spec = Spec.of(engine.config, **given)
    name = chosen(engine, spec)
    frame = build(engine, relation, spec)
    e = estimate(frame.rows, estimand=estimand, estimator=name, n=frame.n, n_treated=frame.n_treated, folds=frame.folds, binary=frame.binary_outcome, trim=spec.trim, reps=spec.bootstrap_reps, seed=spec.seed, clustered=frame.clustered)
    se, low, high, p = e.bounds()
    return engine.table([(estimand, name, e.estimate, se, low, high, p, e.n, e.n_treated, e.n_trimmed, e.variance_method, frame.warnings + e.warnings)], EFFECT)


def do_ate(engine, relation, **given):
    """Average treatment effect: one row."""
    return effect(engine, relation, "ATE", **given)


def do_att(engine, relation, **given):
    """Average effect on the treated: one row."""
    return effect(engine, relation, "ATT", **given)


def do_atc(engine, relation, **given):
    """Average effect on the controls: one row."""
    return effect(engine, relation, "ATC", **given)


def effects_of_rows(engine, relation, spec: Spec):
    """The frame, its fit, and rows with their conditional effects."""
    frame = build(engine, relation, spec)
    fit = nuisance(frame.rows, frame.folds, frame.binary_outcome, spec.trim)
    learner = (spec.estimator or "dr_learner").lower()
    rows, learner = cate(fit, learner if learner in ("s_learner", "t_learner", "x_learner") else "dr_learner", frame.clustered)
    return frame, fit, rows, learner


def numbered(df, spec: Spec, width: int):
    """With ``row_id``, the rank of a row's content."""
    order = ["_y", "_t", *(f"x{j}" for j in range(width)), "_key"]
    df = ranked(df, order, "row_id")
    return df if spec.id else df.withColumn("_id", F.lit(None).cast("string"))


def do_cate(engine, relation, **given):
    """Conditional effect of each row, with pointwise bounds for the dr_learner."""
    spec = Spec.of(engine.config, **given)
    frame, _, rows, learner = effects_of_rows(engine, relation, spec)
    df = numbered(rows.df, spec, frame.width)
    return df.select("row_id", F.col("_id").alias("id"), F.col("_t").alias("treatment"), F.col("_y").alias("outcome"), F.col("_cate").alias("cate"), F.col("_low").alias("cate_low"), F.col("_high").alias("cate_high"), F.lit(learner).alias("learner"))


GROUP = "estimand string, estimator string, estimate double, std_error double, ci_low double, ci_high double, p_value double, n long, n_treated long, warnings array<string>"


def _local_group(pdf: pd.DataFrame, plan: dict) -> tuple:
    """The effect in one bounded group: encoding, folds and estimate as for a whole relation."""
    warnings: list[str] = []
    t, y = pdf["_t"].to_numpy(float), pdf["_y"].to_numpy(float)
    ok = ~(np.isnan(t) | np.isnan(y))
    pdf, t, y = pdf[ok], t[ok], y[ok]
    n, n1 = len(t), int(t.sum())
    null = (plan["estimand"], plan["estimator"], None, None, None, None, None, n, n1)
    small = min(n1, n - n1)
    if n < 8:
        return (*null, [f"not estimated: only {n} usable rows; at least 8 are needed"])
    if small == 0:
        return (*null, ["not estimated: only one treatment arm has rows"])
    if small < 5:
        return (*null, [f"not estimated: the smaller arm has {small} rows; at least 5 are needed"])
    if small < 30:
        warnings.append(f"the smaller arm has only {small} rows")
    columns = []
    for c in plan["plain"]:
        v = pd.to_numeric(pdf[c]).to_numpy(float).copy()
        bad = ~np.isfinite(v)
        if bad.all():
            continue
        if bad.any():
            v[bad] = np.sort(v[~bad])[(~bad).sum() // 2]
            columns += [v, bad.astype(float)]
        else:
            columns.append(v)
    for c in plan["text"]:
        found = sorted(x for x in pdf[c].dropna().unique())
        if 2 <= len(found) <= plan["levels"]:
            columns += [(pdf[c] == x).to_numpy(float) for x in found[1:]]
            if pdf[c].isna().any():
                columns.append(pdf[c].isna().to_numpy(float))
    columns = [(v - v.mean()) / v.std(ddof=1) for v in columns if v.std(ddof=1) > 1e-12]
    folds = min(plan["folds"], max(2, n // 4))
    data = {f"x{j}": v for j, v in enumerate(columns)} | {"_t": t, "_y": y, "_key": local_keys(pdf["_key"].to_numpy(np.int64), "_cluster" in pdf)}
    if "_cluster" in pdf:
        data["_cluster"] = pdf["_cluster"].to_numpy(object)
    data["_fold"] = local_folds(data["_key"], t, folds, plan["seed"], "_cluster" in pdf)
    try:
        e = estimate(LocalRows(data, len(columns)), estimand=plan["estimand"], estimator=plan["estimator"], n=n, n_treated=n1, folds=folds, binary=bool(np.isin(y, (0, 1)).all()), trim=plan["trim"], reps=plan["reps"], seed=plan["seed"], clustered="_cluster" in pdf)
    except (CausalError, np.linalg.LinAlgError, ZeroDivisionError) as error:
        return (*null, [f"not estimated: {error}"])
    se, low, high, p = interval(e.estimate, e.std_error)
    return (plan["estimand"], plan["estimator"], e.estimate, se, low, high, p, n, n1, warnings + e.warnings)


#: Large groups whose jobs run side by side.
_AT_ONCE = 4


def do_ate_by(engine, relation, by=None, **given):
    """One average effect for each group of the ``by`` columns; null is a group. A group that has none says why."""
    spec = Spec.of(engine.config, **given)
    name = chosen(engine, spec)
    df = resolve(engine.spark, relation)
    if not by:
        raise CausalError("by is required")
    by = [column(df, b) for b in ([by] if isinstance(by, str) else by)]
    t, y = column(df, spec.treatment), column(df, spec.outcome or "")
    found = levels_of(df, t, 2)
    if len(found) != 2 and spec.treated is None:
        raise CausalError(f'the treatment "{t}" must have exactly two distinct values')
    low, high = (spec.control, spec.treated) if spec.treated is not None else sorted(found, key=str) if isinstance(found[0], str) else found
    c = F.col(f"`{t}`") if spec.treated is None else F.col(f"`{t}`").cast("string")
    used = {t, y, *by, *(column(df, u) for u in (spec.id, spec.cluster) if u), *(column(df, e) for e in spec.exclude)}
    names = [column(df, x) for x in spec.covariates] if spec.covariates is not None else [x for x in df.columns if x not in used]
    kinds = {x: df.schema[x].dataType for x in names}
    text = [x for x in names if kinds[x].typeName() == "string"]
    plain = [x for x in names if x not in text and (is_number(kinds[x]) or kinds[x].typeName() in ("boolean", "date", "timestamp", "timestamp_ntz"))]
    labels = [F.col(f"`{b}`").cast("string").alias(f"_by{i}") for i, b in enumerate(by)]
    cols = [*labels, F.when(c == F.lit(high), 1.0).when(c == F.lit(low), 0.0).alias("_t"), as_double(df, y).alias("_y")]
    cols += [as_double(df, x).alias(f"_p{i}") for i, x in enumerate(plain)] + [F.col(f"`{x}`").alias(f"_s{i}") for i, x in enumerate(text)]
    if spec.cluster:
        cols.append(F.col(f"`{column(df, spec.cluster)}`").cast("string").alias("_cluster"))
    made = df.select(*cols)
    content = ["_cluster"] if spec.cluster else [x for x in made.columns]
    made = made.withColumn("_key", F.xxhash64(*content))
    keys = [f"_by{i}" for i in range(len(by))]
    sizes = made.groupBy(*keys).count().orderBy("count").limit(engine.config.max_groups + 1).collect()
    if len(sizes) > engine.config.max_groups:
        raise CausalError(f"more than max_groups = {engine.config.max_groups} groups; raise max_groups")
    plan = {"estimand": "ATE", "estimator": name, "plain": [f"_p{i}" for i in range(len(plain))], "text": [f"_s{i}" for i in range(len(text))], "levels": engine.config.max_categorical_levels, "folds": spec.folds, "trim": spec.trim, "reps": spec.bootstrap_reps, "seed": spec.seed}
    schema = ", ".join(f"{k} string" for k in keys) + ", " + GROUP
    large = [r for r in sizes if r["count"] > engine.config.group_rows]
    same = lambda r: [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]
    small = made
    for r in large:
        small = small.filter(~reduce(and_, same(r)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([(*head, *_local_group(pdf, plan))], columns=[f.split()[0] for f in schema.split(", ")])

    out = small.groupBy(*keys).applyInPandas(fit, schema)

    def whole(i: int) -> tuple:
        r, part = large[i], parts.filter(F.col("_group") == i).drop("_group")
        inner = {k: v for k, v in given.items() if k not in ("covariates", "treated", "control")} | {"covariates": names, "treated": str(high), "control": str(low)}
        if spec.treated is None:
            part = part.withColumn(t, F.col(f"`{t}`").cast("string"))
        try:
            e = effect(engine, part, "ATE", **inner).first()
            return (*(r[k] for k in keys), *(e[f.split()[0]] for f in GROUP.split(", ")))
        except CausalError as error:
            return (*(r[k] for k in keys), "ATE", name, None, None, None, None, None, r["count"], None, [f"not estimated: {error}"])

    rows = []
    if large:
        # Each large group's rows are written once, to files of its own, so that no group reads the others.
        at = lambda r: reduce(and_, (F.col(f"`{b}`").cast("string").eqNullSafe(F.lit(r[k])) for k, b in zip(keys, by, strict=True)))
        needed = [x for x in df.columns if x in used or x in names]
        dealt = df.select(*needed, F.coalesce(*(F.when(at(r), i) for i, r in enumerate(large))).alias("_group")).filter("_group is not null")
        parts = stored(dealt, "groups", by="_group")
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            rows = list(pool.map(whole, range(len(large))))
    if rows:
        out = out.unionByName(engine.table(rows, schema))
    for k, b in zip(keys, by, strict=True):
        out = out.withColumnRenamed(k, b)
    return out.orderBy(*(F.col(f"`{b}`").asc_nulls_first() for b in by))


POOL = "estimand string, estimate double, std_error double, ci_low double, ci_high double, p_value double, n_sites long, n long, q double, q_p_value double, i_squared double, warnings array<string>"


def do_ate_pool(engine, relation, estimate: str = "estimate", std_error: str = "std_error", n: str = "n"):
    """Effects of sites pooled by their sizes, with Cochran's Q and I squared. Two aggregations over the sites."""
    df = resolve(engine.spark, relation)
    e, s, size = (as_double(df, column(df, x)) for x in (estimate, std_error, n))
    estimand, weight, warnings = F.lit("ATE"), size, []
    if "estimand" in [c.lower() for c in df.columns]:
        kinds = [r[0] for r in df.select(F.col(column(df, "estimand"))).distinct().limit(3).collect()]
        if len(kinds) > 1:
            raise CausalError("the sites estimate different things: mixed estimands cannot be pooled")
        if kinds and kinds[0] not in ("ATE", "ATT", "ATC"):
            raise CausalError(f'the estimand "{kinds[0]}" cannot be pooled')
        if kinds:
            estimand = F.lit(kinds[0])
            if kinds[0] != "ATE":
                treated = as_double(df, column(df, "n_treated"))
                weight = treated if kinds[0] == "ATT" else size - treated
    d = df.select(e.alias("e"), s.alias("s"), size.alias("n"), weight.alias("w"))
    whole = F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("w").isNotNull()
    first = d.agg(F.sum((~whole).cast("long")).alias("skipped"), F.sum(F.when(whole, 1)).alias("k"), F.sum(F.when(whole, F.col("w"))).alias("w"), F.sum(F.when(whole, F.col("w") * F.col("e"))).alias("we"), F.sum(F.when(whole, F.col("n"))).alias("n"), F.min(F.when(whole, F.col("s"))).alias("least"), F.sum(F.when(whole, 1 / (F.col("s") * F.col("s")))).alias("iw"), F.sum(F.when(whole, F.col("e") / (F.col("s") * F.col("s")))).alias("ie")).first()
    k = first["k"] or 0
    if k < 2:
        raise CausalError("pooling needs at least two sites")
    if first["skipped"]:
        warnings.append(f"{first['skipped']} sites with nulls were skipped")
    if first["least"] < 0 or not first["w"] > 0:
        raise CausalError("standard errors must not be negative and weights must be positive")
    est = first["we"] / first["w"]
    second = d.filter(whole).agg(F.sum((F.col("w") / first["w"] * F.col("s")) ** 2).alias("v"), F.sum(F.when(F.col("s") > 0, ((F.col("e") - F.lit(first["ie"] / first["iw"] if first["iw"] else 0.0)) / F.col("s")) ** 2)).alias("q")).first()
    se, low, high, p = interval(est, second["v"] ** 0.5)
    q = second["q"] if first["least"] > 0 else None
    tail = chi_square_tail(q, k - 1) if q is not None else None
    i2 = max(0.0, (q - (k - 1)) / q) if q else (0.0 if q is not None else None)
    label = df.select(estimand).first()[0]
    return engine.table([(label, est, se, low, high, p, k, int(round(first["n"] or 0)), q, tail, i2, warnings)], POOL)
