"""The causal frame: a relation's treatment, outcome and encoded covariates as rows of numbers.

Rows with a null treatment or outcome go. Numeric covariates keep their nulls as the upper median and a missing mark, text
becomes a mark for each level but the first, constant features go, and the rest is standardised. One job looks at the
columns, one at the features; the rows themselves stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..errors import CausalError
from ..sources.relation import column, resolve
from .ordinals import dealt, numbered
from .rows import SparkRows


@dataclass(frozen=True)
class Spec:
    """Parameters that most operators share; counts that are not positive mean the setting."""

    treatment: str | None = None
    outcome: str | None = None
    covariates: list | None = None
    exclude: list = field(default_factory=list)
    estimator: str = ""
    model: str = ""
    graph: str = ""
    id: str | None = None
    treated: str | None = None
    control: str | None = None
    seed: int = 42
    folds: int = 5
    bootstrap_reps: int = 200
    trim: float = 0.01
    ensemble: int = 1
    cluster: str | None = None
    instrument: str | None = None
    mediator: str | None = None
    event: str | None = None
    policy: str | None = None
    reference: str | None = None

    @classmethod
    def of(cls, config: Config, **given) -> Spec:
        known = {f for f in cls.__dataclass_fields__}
        for k in given:
            if k not in known:
                raise CausalError(f'unknown parameter "{k}"')
        given = {k: v for k, v in given.items() if v is not None or k == "covariates"}
        for k, default in (("seed", config.seed), ("bootstrap_reps", config.bootstrap_reps), ("folds", 5), ("ensemble", config.ensemble_draws)):
            given[k] = int(given[k]) if int(given.get(k, 0)) > 0 else default
        given["folds"] = max(2, given["folds"])
        trim = float(given.get("trim", 0.01))
        if not 0 <= trim < 0.5:
            raise CausalError("trim must be in [0, 0.5)")
        spec = cls(**(given | {"trim": trim}))
        if not spec.treatment:
            raise CausalError("treatment is required")
        return replace(spec, estimator=(spec.estimator or "").lower())


@dataclass
class Feature:
    name: str
    source: str
    kind: str  # NUMERIC, ONE_HOT or MISSING_INDICATOR
    level: str | None = None
    center: float = 0.0
    scale: float = 1.0
    missing: bool = False


@dataclass
class Frame:
    rows: SparkRows
    spec: Spec
    features: list[Feature]
    n: int
    n_treated: int
    n_missing: int
    binary_outcome: bool
    treated_label: str | None
    control_label: str | None
    levels: list[str]
    clusters: int
    warnings: list[str]
    folds: int

    def __getstate__(self):
        return self.__dict__ | {"rows": None}  # tasks get what the frame says, not the frame's rows

    @property
    def width(self) -> int:
        return len(self.features)

    @property
    def clustered(self) -> bool:
        return self.spec.cluster is not None


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, _NUMBERS)


def as_double(df: DataFrame, name: str):
    """A covariate as a double: times are seconds since 1970."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, _TIMES):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return c.cast("double")


def order_statistics(df: DataFrame, value, places: list[int]) -> list[float]:
    """Values at places (from 0) of the sorted non-null values."""
    return grouped_order_statistics(df.select(F.lit(0).alias("k"), value.alias("v")), {0: places})[0]


def grouped_order_statistics(df: DataFrame, places: dict[int, list[int]]) -> dict[int, list[float]]:
    """Values at places (from 0) of the sorted non-null ``v`` of each ``k``: one distributed sort of the distinct ones with their counts, then one row for each place."""
    from ..plans.storage import stored

    counts = df.filter("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    ordered = stored(counts.orderBy("k", "v").select("k", "v", "n", F.spark_partition_id().alias("p")), "ordered")
    before, inside = dict.fromkeys(places, 0), {}
    for k, p, n in sorted((r["k"], r["p"], r["n"]) for r in ordered.groupBy("k", "p").agg(F.sum("n").alias("n")).collect()):
        if k in places:
            inside |= {(k, at): (p, at - before[k]) for at in places[k] if before[k] <= at < before[k] + n}
            before[k] += n
    # Only stretches that hold a place are gone through, each value by value.
    upto = F.sum("n").over(Window.partitionBy("k", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = ordered.filter(F.col("p").isin(sorted({p for p, _ in inside.values()}))).select("k", "p", "v", "n", upto.alias("upto"))
    wanted = [(F.col("k") == k) & (F.col("p") == p) & (F.col("upto") - F.col("n") <= at) & (F.col("upto") > at) for k, p, at in sorted({(k, p, at) for (k, _), (p, at) in inside.items()})]
    found: dict[tuple, list] = {}
    for r in run.filter(reduce(or_, wanted)).collect() if wanted else []:
        found.setdefault((r["k"], r["p"]), []).append((r["upto"] - r["n"], r["upto"], r["v"]))
    at_ = lambda k, p, at: next(v for low, high, v in found[k, p] if low <= at < high)
    return {k: [at_(k, *inside[k, at]) for at in some] for k, some in places.items()}


def levels_of(df: DataFrame, name: str, most: int) -> list:
    """Distinct non-null values in their natural order, one more than ``most`` at most."""
    return [r[0] for r in df.select(F.col(f"`{name}`").alias("v")).filter("v is not null").distinct().orderBy("v").limit(most + 1).collect()]


def _treatment(df: DataFrame, spec: Spec, mode: str):
    """Column of the treatment, labels, and levels."""
    name = column(df, spec.treatment)
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if mode == "continuous":
        if not is_number(kind):
            raise CausalError(f'the treatment "{name}" must be numeric here')
        return c.cast("double"), None, None, []
    if mode == "multi":
        found = levels_of(df, name, 20)
        if len(found) > 20:
            raise CausalError(f'the treatment "{name}" has more than 20 levels')
        if len(found) < 2:
            raise CausalError(f'the treatment "{name}" needs at least two levels')
        names = [_text(v) for v in found]
        code = F.lit(None).cast("double")
        for k, v in enumerate(found):
            code = F.when(c == F.lit(v), float(k)).otherwise(code)
        return code, None, None, names
    if spec.treated is not None or spec.control is not None:
        if spec.treated is None or spec.control is None:
            raise CausalError("treated and control go together")
        text = c.cast("string")
        return F.when(text == str(spec.treated), 1.0).when(text == str(spec.control), 0.0), str(spec.treated), str(spec.control), []
    found = levels_of(df, name, 2)
    if len(found) != 2:
        raise CausalError(f'the treatment "{name}" must have exactly two distinct values; it has {"more than 2" if len(found) > 2 else len(found)}. Use treated and control to pick two')
    low, high = sorted(found, key=str) if isinstance(kind, T.StringType) else found
    return F.when(c == F.lit(high), 1.0).when(c == F.lit(low), 0.0), _text(high), _text(low), []


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def build(engine, relation, spec: Spec, mode: str = "binary", outcome: bool = True, extra: dict | None = None) -> Frame:
    """The frame of a relation; ``extra`` names further columns: each becomes a double, its nulls 0."""
    config, warnings = engine.config, []
    df = resolve(engine.spark, relation)
    used = [spec.treatment, spec.outcome, spec.id, spec.cluster, spec.policy, spec.instrument, spec.mediator, spec.event, *(extra or {}).values()]
    used = {column(df, u) for u in used if u}
    left_out = {column(df, e) for e in spec.exclude}
    names = [column(df, c) for c in spec.covariates] if spec.covariates is not None else [c for c in df.columns if c not in used and c not in left_out]
    for c in names:
        if spec.covariates is not None and c in used - ({column(df, spec.cluster)} if spec.cluster else set()) and c != (spec.id and column(df, spec.id)):
            raise CausalError(f'"{c}" cannot be a covariate: it has another part')
    t, treated, control, levels = _treatment(df, spec, mode)
    base = [t.alias("_t")]
    binary = False
    if outcome:
        if not spec.outcome:
            raise CausalError("outcome is required")
        y = column(df, spec.outcome)
        kind = df.schema[y].dataType
        if not (is_number(kind) or isinstance(kind, T.BooleanType)):
            raise CausalError(f'the outcome "{y}" must be numeric or boolean')
        base.append(as_double(df, y).alias("_y"))
    else:
        base.append(F.lit(0.0).alias("_y"))
    aux = spec.instrument or spec.mediator or spec.event
    if aux:
        base.append(F.coalesce(as_double(df, column(df, aux)), F.lit(0.0)).alias("_aux"))
    for alias, name in (extra or {}).items():
        base.append(F.coalesce(as_double(df, column(df, name)), F.lit(0.0)).alias(alias))
    if spec.cluster:
        base.append(F.col(f"`{column(df, spec.cluster)}`").cast("string").alias("_cluster"))
    if spec.id:
        base.append(F.col(f"`{column(df, spec.id)}`").cast("string").alias("_id"))
    if spec.policy:
        base.append(F.coalesce(as_double(df, column(df, spec.policy)), F.lit(0.0)).alias("_policy"))
    plain, text = [], []
    for c in names:
        kind = df.schema[c].dataType
        if is_number(kind) or isinstance(kind, (T.BooleanType, *_TIMES)):
            plain.append(c)
        elif isinstance(kind, T.StringType):
            text.append(c)
        else:
            warnings.append(f'covariate "{c}" was dropped: its type {kind.simpleString()} is not supported')
    value = {c: f"_c{i}" for i, c in enumerate(names)}
    finite = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    base += [finite(as_double(df, c)).alias(value[c]) for c in plain] + [F.col(f"`{c}`").alias(value[c]) for c in text]
    raw = df.select(*base).filter("_t is not null and _y is not null").persist()
    look = [F.count(F.lit(1)).alias("n"), F.sum("_t").alias("s"), F.min("_y").alias("low"), F.max("_y").alias("high"), F.sum((~F.col("_y").isin(0.0, 1.0)).cast("long")).alias("odd")]
    look += [F.sum(F.col(value[c]).isNull().cast("long")).alias(f"m{value[c]}") for c in plain + text]
    if spec.cluster:
        look += [F.sum(F.col("_cluster").isNull().cast("long")).alias("nc"), F.count_distinct("_cluster").alias("clusters")]
    if spec.id:
        look.append(F.approx_count_distinct("_id").alias("ids"))
    for k in range(len(levels)):
        look.append(F.sum((F.col("_t") == k).cast("long")).alias(f"level{k}"))
    seen = raw.agg(*look).first()
    n = seen["n"]
    if n > config.max_rows:
        raise CausalError(f"{n} rows exceed max_rows = {config.max_rows}; raise max_rows or sample the relation")
    if n < 8:
        raise CausalError(f"only {n} usable rows; at least 8 are needed")
    n_treated = int(round(seen["s"] or 0)) if mode == "binary" else 0
    if mode == "binary":
        small = min(n_treated, n - n_treated)
        if small == 0:
            raise CausalError("only one treatment arm has rows")
        if small < 5:
            raise CausalError(f"the smaller arm has {small} rows; at least 5 are needed")
        if small < 30:
            warnings.append(f"the smaller arm has only {small} rows")
    for k, level in enumerate(levels):
        if (seen[f"level{k}"] or 0) < 5:
            raise CausalError(f'level "{level}" has {seen[f"level{k}"] or 0} rows; at least 5 are needed')
        if seen[f"level{k}"] < 30:
            warnings.append(f'level "{level}" has only {seen[f"level{k}"]} rows')
    clusters = 0
    if spec.cluster:
        if seen["nc"]:
            raise CausalError(f'the cluster column "{spec.cluster}" has {seen["nc"]} nulls')
        clusters = seen["clusters"]
        if clusters < 10:
            raise CausalError(f"only {clusters} clusters; at least 10 are needed")
        if clusters < 50:
            warnings.append(f"only {clusters} clusters: clustered errors need many")
        if clusters == n:
            warnings.append("every row is a cluster of its own")
    if outcome:
        binary = seen["odd"] == 0
    features, exprs = [], []
    for c in names:
        v, missing = value[c], seen[f"m{value[c]}"] if c in plain + text else 0
        if c in plain:
            if missing == n:
                warnings.append(f'covariate "{c}" was dropped: all its values are missing')
                continue
            x = F.col(v)
            if missing:
                x = F.coalesce(x, F.lit(order_statistics(raw, F.col(v), [(n - missing) // 2])[0]))
            features.append(Feature(c, c, "NUMERIC", missing=bool(missing)))
            exprs.append(x)
        elif c in text:
            found = levels_of(raw, v, config.max_categorical_levels)
            if len(found) > config.max_categorical_levels:
                warnings.append(f'covariate "{c}" was dropped: more than max_categorical_levels = {config.max_categorical_levels} levels')
                continue
            if len(found) < 2:
                warnings.append(f'covariate "{c}" was dropped: fewer than two levels')
                continue
            for level in sorted(found)[1:]:
                features.append(Feature(f"{c}={level}", c, "ONE_HOT", level))
                exprs.append(F.when(F.col(v) == level, 1.0).otherwise(0.0))
        else:
            continue
        if missing:
            features.append(Feature(f"{c}__missing", c, "MISSING_INDICATOR"))
            exprs.append(F.col(v).isNull().cast("double"))
    if features:
        stats = raw.agg(*(f(x).alias(f"{k}{j}") for j, x in enumerate(exprs) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        kept = []
        for j, (f, x) in enumerate(zip(features, exprs, strict=True)):
            sd = stats[f"s{j}"]
            if sd is None or not sd > 1e-12:
                warnings.append(f'feature "{f.name}" was dropped: it is constant')
                continue
            f.center, f.scale = stats[f"m{j}"], sd
            kept.append((f, (x - f.center) / f.scale))
        features = [f for f, _ in kept]
        exprs = [x for _, x in kept]
    if len(features) > config.max_features:
        raise CausalError(f"{len(features)} features exceed max_features = {config.max_features}; raise max_features or name fewer covariates")
    if spec.id and seen["ids"] < 0.9 * n:
        warnings.append(f'the id "{spec.id}" repeats')
    missing_any = F.greatest(*(F.col(value[c]).isNull().cast("int") for c in plain + text), F.lit(0)) if len(plain + text) > 1 else (F.col(value[(plain + text)[0]]).isNull().cast("int") if plain + text else F.lit(0))
    n_missing = int(raw.agg(F.sum(missing_any)).first()[0] or 0) if any(seen[f"m{value[c]}"] for c in plain + text) else 0
    folds = min(spec.folds, max(2, n // 4))
    aliases = [a.alias(f"x{j}") for j, a in enumerate(exprs)]
    carried = [c for c in raw.columns if c not in value.values()]
    # A row's draws are hashes of its content and the seed: they do not depend on its place or partition. The content is
    # that of the relation, since means and deviations depend on the order of sums in their last digits.
    key = F.xxhash64(*(["_cluster"] if spec.cluster else [c for c in raw.columns if c != "_id"]))
    # Equal rows have draws of their own: the key counts them. Rows of a cluster share theirs.
    made = raw.select(*carried, *aliases, key.alias("_key"))
    made = made if spec.cluster else numbered(made)
    made = dealt(made, folds, spec.seed, "_t" if mode in ("binary", "multi") and not spec.cluster else None)
    return Frame(SparkRows(made, len(features)).keep(), spec, features, n, n_treated, n_missing, binary, treated, control, levels, clusters, warnings, folds)


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """With a gapless rank from 0 in a total order, by a distributed sort and the partitions' counts."""
    from ..plans.storage import stored

    ordered = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_m", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.expr("_m & ((1L << 33) - 1)")).drop("_part", "_before", "_m")


