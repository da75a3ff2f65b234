"""Queries of the library's own operators over the test tables, and their SQL counterparts where SQL can say the same.

A relation is one SQL text for both engines: ``{orders}`` stands for a table. Results are rounded, as sums of doubles
depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: Orders with their customers; the treatment is an urgent priority.
ORDERS = """SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderstatus, o.o_orderpriority, c.c_acctbal, c.c_mktsegment, c.c_nationkey,
 CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent, CASE WHEN o.o_totalprice > 250000 THEN 1 ELSE 0 END AS large
 FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"""
#: Users by six spans of five days; a user adopts in the first span with four purchases.
PANEL = """SELECT user_id, CAST(least(floor((dayofmonth(ts) - 1) / 5), 5) AS INT) AS span, avg(value) AS y,
 sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) >= 4 AS bought, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS errors,
 CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) >= 5 AS INT) AS left_us
 FROM {events} GROUP BY user_id, CAST(least(floor((dayofmonth(ts) - 1) / 5), 5) AS INT)"""
#: The same until the first span in which a user leaves.
SPELLS = f"""SELECT user_id, span, errors, bought, left_us FROM (SELECT p.*, min(CASE WHEN left_us = 1 THEN span END) OVER (PARTITION BY user_id) AS ending,
 min(span) OVER (PARTITION BY user_id) AS began, row_number() OVER (PARTITION BY user_id ORDER BY span) AS k FROM ({PANEL}) p) q
 WHERE (ending IS NULL OR span <= ending) AND began = 0 AND span = k - 1"""
#: Mean order value of nations by year; nation 3 is treated from 1998 on.
NATIONS = """SELECT c.c_nationkey AS nation, year(o.o_orderdate) AS yr, avg(o.o_totalprice) AS y, (c.c_nationkey = 3 AND year(o.o_orderdate) >= 1998) AS treated
 FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, year(o.o_orderdate)"""
#: Lines as spells: quantities are durations, return flags are causes of their end.
LINES = """SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS t, l_quantity AS d, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS cause,
 CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS ended, l_extendedprice, l_tax, l_discount, l_returnflag, l_discount * l_extendedprice AS saved FROM {lineitem}"""
#: Effects by nation, as sites would report them.
SITES = f"""SELECT c_nationkey, avg(CASE WHEN urgent = 1 THEN o_totalprice END) - avg(CASE WHEN urgent = 0 THEN o_totalprice END) AS estimate,
 sqrt(var_samp(CASE WHEN urgent = 1 THEN o_totalprice END) / count(CASE WHEN urgent = 1 THEN 1 END) + var_samp(CASE WHEN urgent = 0 THEN o_totalprice END) / count(CASE WHEN urgent = 0 THEN 1 END)) AS std_error,
 count(*) AS n FROM ({ORDERS}) o GROUP BY c_nationkey"""
GRAPH = "digraph { segment -> urgent; segment -> price; balance -> urgent; balance -> price; urgent -> price; region -> urgent }"

ORDER_SPEC = {"treatment": "urgent", "outcome": "o_totalprice", "covariates": ["c_acctbal", "c_mktsegment"]}
LARGE_SPEC = ORDER_SPEC | {"outcome": "large"}
PANEL_SPEC = {"unit": "user_id", "period": "span", "treatment": "bought", "outcome": "y"}
NATION_SPEC = {"unit": "nation", "period": "yr", "treatment": "treated", "outcome": "y"}
LINE_SPEC = {"treatment": "t", "duration": "d"}


def relation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def rounded(df: DataFrame, columns: str, digits: int = 4) -> DataFrame:
    """The named columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns.split()))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, op: str, text: str | None, shown: str = "", oracle: str = "", digits: int = 4, **given) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        args = (relation(spark, sf_dir, text),) if text else ()
        out = getattr(engine, op)(*args, **given)
        return rounded(out, shown, digits) if shown else out

    query.__name__ = name
    QUERIES[name] = query
    if oracle:
        ORACLE_SQL[name] = duck(oracle)


_EFFECT = "estimand estimator estimate std_error n n_treated n_trimmed"
_NAIVE = """round(avg(CASE WHEN urgent = 1 THEN o_totalprice END) - avg(CASE WHEN urgent = 0 THEN o_totalprice END), 4) AS estimate,
 round(sqrt(var_samp(CASE WHEN urgent = 1 THEN o_totalprice END) / sum(urgent) + var_samp(CASE WHEN urgent = 0 THEN o_totalprice END) / sum(1 - urgent)), 4) AS std_error,
 count(*) AS n, CAST(sum(urgent) AS BIGINT) AS n_treated"""

# Effects
_add("ate_naive", "do_ate", ORDERS, _EFFECT, f"SELECT 'ATE' AS estimand, 'naive' AS estimator, {_NAIVE}, CAST(0 AS BIGINT) AS n_trimmed FROM ({ORDERS}) o", **(ORDER_SPEC | {"estimator": "naive"}))
_add(
    "ate_naive_clustered", "do_ate", ORDERS, "estimate std_error n",
    f"""WITH o AS ({ORDERS}), m AS (SELECT avg(CASE WHEN urgent = 1 THEN o_totalprice END) AS m1, avg(CASE WHEN urgent = 0 THEN o_totalprice END) AS m0, sum(urgent) AS n1, sum(1 - urgent) AS n0 FROM o),
 s AS (SELECT o_custkey, sum(CASE WHEN urgent = 1 THEN (o_totalprice - m1) / n1 ELSE -(o_totalprice - m0) / n0 END) AS s, count(*) AS n, any_value(m1 - m0) AS e FROM o, m GROUP BY o_custkey)
 SELECT round(any_value(e), 4) AS estimate, round(sqrt(count(*) / (count(*) - 1) * sum(s * s)), 4) AS std_error, CAST(sum(n) AS BIGINT) AS n FROM s""",
    **(ORDER_SPEC | {"estimator": "naive", "cluster": "o_custkey"}),
)
for _e in ("aipw", "dml", "ipw", "regression"):
    _add(f"ate_{_e}", "do_ate", ORDERS, _EFFECT, **(ORDER_SPEC | {"estimator": _e, "bootstrap_reps": 100}))
_add("ate_binary_outcome", "do_ate", ORDERS, _EFFECT, **LARGE_SPEC)
for _k in ("att", "atc"):
    _add(f"{_k}_naive", f"do_{_k}", ORDERS, _EFFECT, f"SELECT '{_k.upper()}' AS estimand, 'naive' AS estimator, {_NAIVE}, CAST(0 AS BIGINT) AS n_trimmed FROM ({ORDERS}) o", **(ORDER_SPEC | {"estimator": "naive"}))
_add("att", "do_att", ORDERS, _EFFECT, **ORDER_SPEC)
_add("atc", "do_atc", ORDERS, _EFFECT, **ORDER_SPEC)
for _l in ("dr_learner", "s_learner", "t_learner", "x_learner"):
    _add(f"cate_{_l}", "do_cate", ORDERS, **(ORDER_SPEC | {"estimator": _l, "id": "o_orderkey"}))
_add("ate_by", "do_ate_by", ORDERS, "c_nationkey estimand estimator estimate std_error n n_treated", **(ORDER_SPEC | {"by": ["c_nationkey"]}))
_add("ate_by_naive", "do_ate_by", ORDERS, "c_mktsegment estimate std_error n n_treated", f"SELECT c_mktsegment, {_NAIVE} FROM ({ORDERS}) o GROUP BY c_mktsegment", **(ORDER_SPEC | {"by": ["c_mktsegment"], "estimator": "naive", "covariates": ["c_acctbal"]}))
_add(
    "ate_pool", "do_ate_pool", SITES, "estimand estimate std_error n_sites n q i_squared",
    f"""WITH s AS ({SITES}), w AS (SELECT sum(n * estimate) / sum(n) AS e, sqrt(sum(n * n * std_error * std_error)) / sum(n) AS se, count(*) AS k, sum(n) AS n,
 sum(estimate / (std_error * std_error)) / sum(1 / (std_error * std_error)) AS fixed FROM s),
 q AS (SELECT sum(((estimate - fixed) / std_error) ** 2) AS q FROM s, w)
 SELECT 'ATE' AS estimand, round(e, 4) AS estimate, round(se, 4) AS std_error, k AS n_sites, CAST(n AS BIGINT) AS n, round(q, 4) AS q, round(greatest(0, (q - (k - 1)) / q), 4) AS i_squared FROM w, q""",
)

# Doses and levels
_add("ape", "do_ape", LINES, "estimand estimator estimate std_error n dose_mean dose_sd dose_min dose_max", treatment="d", outcome="l_extendedprice", covariates=["l_tax", "l_discount"])
_add("dose_response", "do_dose_response", LINES, treatment="d", outcome="l_extendedprice", covariates=["l_tax"], grid=10)
_add("ate_levels", "do_ate_levels", ORDERS, "level reference estimand estimator estimate std_error naive_difference n_level n_reference", treatment="o_orderpriority", outcome="o_totalprice", covariates=["c_acctbal"])
_add(
    "ate_levels_counts", "do_ate_levels", ORDERS, "level reference naive_difference n_level n_reference",
    f"""WITH m AS (SELECT o_orderstatus AS level, avg(o_totalprice) AS m, count(*) AS n FROM ({ORDERS}) o GROUP BY o_orderstatus), r AS (SELECT * FROM m ORDER BY level LIMIT 1)
 SELECT m.level, r.level AS reference, round(m.m - r.m, 4) AS naive_difference, m.n AS n_level, r.n AS n_reference FROM m, r WHERE m.level <> r.level""",
    treatment="o_orderstatus", outcome="o_totalprice", covariates=["c_acctbal"],
)

# Diagnostics
_BALANCE = f"""WITH o AS ({ORDERS}), m AS (SELECT avg(CASE WHEN urgent = 1 THEN c_acctbal END) AS m1, avg(CASE WHEN urgent = 0 THEN c_acctbal END) AS m0, var_pop(CASE WHEN urgent = 1 THEN c_acctbal END) AS v1, var_pop(CASE WHEN urgent = 0 THEN c_acctbal END) AS v0 FROM o)
 SELECT 'c_acctbal' AS covariate, 'c_acctbal' AS feature, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd_raw FROM m"""
_add("balance", "do_balance", ORDERS, **ORDER_SPEC)
_add("balance_raw", "do_balance", ORDERS, "covariate feature smd_raw", _BALANCE, 6, **(ORDER_SPEC | {"covariates": ["c_acctbal"]}))
_add(
    "balance_levels", "do_balance", ORDERS, "covariate feature smd_raw",
    f"""WITH o AS ({ORDERS}), f AS (SELECT urgent, v.m, CASE WHEN o.c_mktsegment = v.m THEN 1.0 ELSE 0.0 END AS x FROM o, (SELECT DISTINCT c_mktsegment AS m FROM o) v WHERE v.m > (SELECT min(c_mktsegment) FROM o)),
 s AS (SELECT m, avg(CASE WHEN urgent = 1 THEN x END) AS m1, avg(CASE WHEN urgent = 0 THEN x END) AS m0, var_pop(CASE WHEN urgent = 1 THEN x END) AS v1, var_pop(CASE WHEN urgent = 0 THEN x END) AS v0 FROM f GROUP BY m)
 SELECT 'c_mktsegment' AS covariate, 'c_mktsegment=' || m AS feature, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd_raw FROM s""",
    6, **(ORDER_SPEC | {"covariates": ["c_mktsegment"]}),
)
_add("overlap", "do_overlap", ORDERS, **ORDER_SPEC)
_add("diagnose", "do_diagnose", ORDERS, **ORDER_SPEC)
for _m in ("placebo_treatment", "random_common_cause", "subset", "bootstrap", "unobserved_confounder"):
    _add(f"refute_{_m}", "do_refute", ORDERS, method=_m, **ORDER_SPEC)
_add("sensitivity", "do_sensitivity", ORDERS, **ORDER_SPEC)
_add(
    "frame_summary", "do_frame_summary", ORDERS, "feature source kind level center scale n n_features n_treated n_rows_with_missing treated_label control_label",
    f"""WITH o AS ({ORDERS}), s AS (SELECT count(*) AS n, sum(urgent) AS n1 FROM o), f AS (
 SELECT 'c_acctbal' AS feature, 'c_acctbal' AS source, 'NUMERIC' AS kind, CAST(NULL AS VARCHAR) AS level, avg(c_acctbal) AS c, stddev_samp(c_acctbal) AS s FROM o
 UNION ALL SELECT 'c_mktsegment=' || v.m, 'c_mktsegment', 'ONE_HOT', v.m, avg(CASE WHEN o.c_mktsegment = v.m THEN 1.0 ELSE 0.0 END), stddev_samp(CASE WHEN o.c_mktsegment = v.m THEN 1.0 ELSE 0.0 END)
 FROM o, (SELECT DISTINCT c_mktsegment AS m FROM o) v WHERE v.m > (SELECT min(c_mktsegment) FROM o) GROUP BY v.m)
 SELECT feature, source, kind, level, round(c, 4) AS center, round(f.s, 4) AS scale, n, count(*) OVER () AS n_features, CAST(n1 AS BIGINT) AS n_treated, CAST(0 AS BIGINT) AS n_rows_with_missing, '1' AS treated_label, '0' AS control_label FROM f, s""",
    **ORDER_SPEC,
)

# Graphs
def _pricing(spark: SparkSession) -> Engine:
    engine = Engine(spark)
    engine.do_graph_create("pricing", GRAPH).collect()
    return engine


def identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pricing(spark).do_identify("pricing", "urgent", "price").select("strategy", "identifiable", "adjustment_set")


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pricing(spark).do_validate("pricing", "urgent", "price", ["segment", "balance", "region"]).select("covariate", "role", "verdict")


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _pricing(spark)
    out = spark.createDataFrame(engine.do_graphs().filter("name = 'pricing'").select("name", "n_nodes", "n_edges").collect(), "name string, n_nodes long, n_edges long")
    engine.do_graph_drop("pricing").collect()
    return out


def dseparated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar function inside SQL text."""
    return _pricing(spark).sql("SELECT do_dseparated('pricing', 'region', 'price', array('urgent', 'segment', 'balance')) AS given_all, do_dseparated('pricing', 'region', 'balance', array()) AS apart")


QUERIES |= {"graphs": graphs, "dseparated": dseparated, "identify": identify, "validate": validate}
ORACLE_SQL |= {
    "identify": "SELECT * FROM (VALUES ('backdoor', true, ['segment', 'balance']), ('frontdoor', false, CAST([] AS VARCHAR[])), ('iv', true, ['region'])) v(strategy, identifiable, adjustment_set)",
    "validate": "SELECT * FROM (VALUES ('segment', 'confounder', 'keep'), ('balance', 'confounder', 'keep'), ('region', 'instrument', 'DROP')) v(covariate, role, verdict)",
}
ORACLE_SQL |= {"graphs": "SELECT 'pricing' AS name, CAST(5 AS BIGINT) AS n_nodes, CAST(6 AS BIGINT) AS n_edges", "dseparated": "SELECT true AS given_all, true AS apart"}

# Instruments, front door, mediation
_add(
    "iv", "do_iv", LINES, "estimand estimator estimate n",
    f"SELECT 'LATE' AS estimand, '2sls' AS estimator, round(covar_samp(saved, d) / covar_samp(l_extendedprice, d), 4) AS estimate, count(*) AS n FROM ({LINES}) l",
    treatment="l_extendedprice", outcome="saved", instrument="d", covariates=[],
)
_add("iv_covariates", "do_iv", LINES, "estimand estimate std_error n first_stage_f weak_instrument", treatment="l_extendedprice", outcome="saved", instrument="d", covariates=["l_tax"])
_RESIDUAL = f"""WITH l AS ({LINES}), b AS (SELECT regr_slope(d, l_tax) AS b, regr_intercept(d, l_tax) AS a FROM l), z AS (SELECT l.*, d - a - b * l_tax AS z FROM l, b)"""
_add(
    "iv_one_covariate", "do_iv", LINES, "estimand estimator estimate n",
    f"{_RESIDUAL} SELECT 'LATE' AS estimand, '2sls' AS estimator, round(covar_samp(saved, z) / covar_samp(l_extendedprice, z), 4) AS estimate, count(*) AS n FROM z",
    treatment="l_extendedprice", outcome="saved", instrument="d", covariates=["l_tax"],
)
_add(
    "frontdoor", "do_frontdoor", LINES, "estimand estimator estimate n effect_t_on_m effect_m_on_y",
    f"""WITH l AS (SELECT *, ended AS m FROM ({LINES}) x), a AS (SELECT avg(CASE WHEN t = 1 THEN m END) - avg(CASE WHEN t = 0 THEN m END) AS a, count(*) AS n FROM l),
 b AS (SELECT t, avg(CASE WHEN m = 1 THEN l_extendedprice END) - avg(CASE WHEN m = 0 THEN l_extendedprice END) AS b, count(*) AS k FROM l GROUP BY t)
 SELECT 'ATE' AS estimand, 'frontdoor' AS estimator, round(any_value(a) * sum(b * k) / any_value(n), 4) AS estimate, any_value(n) AS n, round(any_value(a), 4) AS effect_t_on_m, round(sum(b * k) / any_value(n), 4) AS effect_m_on_y FROM a, b""",
    treatment="t", outcome="l_extendedprice", mediator="ended", covariates=[],
)
_add("mediate", "do_mediate", LINES, "estimand estimator estimate n", treatment="t", outcome="l_extendedprice", mediator="d", covariates=["l_tax"], bootstrap_reps=100)

# Policies
_add("counterfactual", "do_counterfactual", ORDERS, **(ORDER_SPEC | {"id": "o_orderkey"}))
_add("predict", "do_predict", ORDERS, intervention={"urgent": 1, "c_acctbal": 5000.0}, **(ORDER_SPEC | {"id": "o_orderkey"}))
_add("policy_value", "do_policy_value", ORDERS, threshold=100.0, **ORDER_SPEC)
_add("policy_value_column", "do_policy_value", ORDERS, policy="large", **ORDER_SPEC)
_add("uplift", "do_uplift", ORDERS, **ORDER_SPEC)
_add("optimal_policy", "do_optimal_policy", ORDERS, **ORDER_SPEC)

# Panels
_DID = f"""WITH p AS ({PANEL}), f AS (SELECT user_id, min(CASE WHEN bought THEN span END) AS g FROM p GROUP BY user_id), x AS (SELECT p.*, f.g FROM p JOIN f USING (user_id)),
 cohorts AS (SELECT DISTINCT g FROM f WHERE g >= 1), d AS (SELECT c.g, b.span AS t, b.g AS own, b.y - a.y AS dy FROM cohorts c JOIN x a ON a.span = c.g - 1 JOIN x b ON b.user_id = a.user_id AND b.span <> c.g - 1 WHERE b.g = c.g OR b.g IS NULL),
 cells AS (SELECT g, t, avg(CASE WHEN own IS NOT NULL THEN dy END) - avg(CASE WHEN own IS NULL THEN dy END) AS att, count(own) AS n FROM d GROUP BY g, t)"""
_add("did", "do_did", PANEL, "estimand estimate n_units n_periods n_cohorts n_never_treated", f"""{_DID} SELECT 'ATT' AS estimand, round(sum(att * n) / sum(n), 4) AS estimate, (SELECT count(*) FROM f) AS n_units, (SELECT count(DISTINCT span) FROM p) AS n_periods,
 count(DISTINCT g) AS n_cohorts, (SELECT count(*) FROM f WHERE g IS NULL) AS n_never_treated FROM cells WHERE t >= g""", **PANEL_SPEC, covariates=[], bootstrap_reps=50)
_add("event_study", "do_event_study", PANEL, "relative_period att n_treated is_pre_treatment", f"{_DID} SELECT CAST(t - g AS BIGINT) AS relative_period, round(sum(att * n) / sum(n), 4) AS att, CAST(sum(n) AS BIGINT) AS n_treated, t - g < 0 AS is_pre_treatment FROM cells GROUP BY t - g", **PANEL_SPEC, covariates=[], bootstrap_reps=50)
_add("did_covariates", "do_did", PANEL, "estimand estimator estimate n_units", **PANEL_SPEC, covariates=["errors"], bootstrap_reps=50)
_add("synth", "do_synth", NATIONS, **NATION_SPEC)
_add("synth_path", "do_synth_path", NATIONS, **NATION_SPEC)

# Longitudinal models
for _m in ("cumulative", "by_period", "saturated"):
    _add(f"msm_{_m}", "do_msm", PANEL, unit="user_id", period="span", treatment="bought", outcome="y", covariates=["errors"], model=_m)
_add("msm_rmst", "do_msm_rmst", SPELLS, unit="user_id", period="span", treatment="bought", event="left_us", covariates=["errors"], bootstrap_reps=20)

# Survival
_AREA = f"""WITH l AS ({LINES}), h AS (SELECT CAST(40 AS DOUBLE) AS h), k AS (SELECT t, d, count(*) AS n, sum(ended) AS e, sum(CASE WHEN cause = 1 THEN 1 ELSE 0 END) AS c FROM l GROUP BY t, d),
 r AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY d DESC) AS r FROM k), s AS (SELECT *, exp(sum(CASE WHEN e >= r THEN -700 ELSE ln(1 - CAST(e AS DOUBLE) / r) END) OVER (PARTITION BY t ORDER BY d)) AS s FROM r),
 v AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY t ORDER BY d), 1) AS before FROM s)"""
_add("rmst", "do_rmst", LINES, "estimand estimate rmst_treated rmst_control n n_events censored_fraction", f"""{_AREA}, a AS (SELECT t, 40 - sum(CASE WHEN d < h THEN (before - s) * (h - d) ELSE 0 END) AS a FROM v, h GROUP BY t)
 SELECT 'RMST difference' AS estimand, round(max(CASE WHEN t = 1 THEN a END) - max(CASE WHEN t = 0 THEN a END), 3) AS estimate, round(max(CASE WHEN t = 1 THEN a END), 3) AS rmst_treated, round(max(CASE WHEN t = 0 THEN a END), 3) AS rmst_control,
 (SELECT count(*) FROM l) AS n, (SELECT CAST(sum(ended) AS BIGINT) FROM l) AS n_events, (SELECT round(1 - avg(ended), 3) FROM l) AS censored_fraction FROM a""", 3, **LINE_SPEC, event="ended", covariates=[], horizon=40.0, bootstrap_reps=100)
_add("rmtl", "do_rmtl", LINES, "estimand cause estimate rmtl_treated rmtl_control n n_events n_competing", f"""{_AREA}, a AS (SELECT t, sum(CASE WHEN d < h THEN before * c / r * (h - d) ELSE 0 END) AS a FROM v, h GROUP BY t)
 SELECT 'RMTL difference' AS estimand, CAST(1 AS BIGINT) AS cause, round(max(CASE WHEN t = 1 THEN a END) - max(CASE WHEN t = 0 THEN a END), 3) AS estimate, round(max(CASE WHEN t = 1 THEN a END), 3) AS rmtl_treated, round(max(CASE WHEN t = 0 THEN a END), 3) AS rmtl_control,
 (SELECT count(*) FROM l) AS n, (SELECT count(*) FROM l WHERE cause = 1) AS n_events, (SELECT count(*) FROM l WHERE cause > 1) AS n_competing FROM a""", 3, **LINE_SPEC, event="cause", cause=1, covariates=[], horizon=40.0, bootstrap_reps=100)
_add("rmst_covariates", "do_rmst", LINES, "estimand estimate std_error horizon", **LINE_SPEC, event="ended", covariates=["l_tax"], bootstrap_reps=100)

# Discovery
_NUMBERS = {"columns": ["l_extendedprice", "d", "saved", "l_tax", "ended"]}
for _a, _g in (("pc", {}), ("fci", {}), ("lingam", {}), ("pc+lingam", {})):
    _add(f"discover_{_a.replace('+', '_')}", "do_discover", LINES, algorithm=_a, bootstrap=10, **_NUMBERS, **_g)
_add("discover_rank", "do_discover", LINES, test="rank", bootstrap=5, tiers=[["d"], ["saved"]], **_NUMBERS)
_add("discover_dot", "do_discover_dot", LINES, bootstrap=0, **_NUMBERS)

# Models
_add("list_models", "do_list_models", None, "model available", "")
_add("devices", "do_devices", None, "device available", "SELECT * FROM (VALUES ('cpu', true), ('cuda', false), ('rocm', false), ('mlx', false)) v(device, available)")


def ate_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators as functions in SQL text."""
    relation(spark, sf_dir, ORDERS).createOrReplaceTempView("causalith_orders")
    return Engine(spark).sql("SELECT estimand, round(estimate, 4) AS estimate, n FROM do_ate('causalith_orders', treatment := 'urgent', outcome := 'o_totalprice', covariates := ['c_acctbal'], estimator := 'naive')")


QUERIES["ate_in_sql"] = ate_in_sql
ORACLE_SQL["ate_in_sql"] = duck(f"SELECT estimand, estimate, n FROM (SELECT 'ATE' AS estimand, {_NAIVE} FROM ({ORDERS}) o) r")
