"""The engine: every operator as a method, and as a function in SQL text."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .config import Config

#: Operators by module of ``operators``.
_MODULES = {
    "diagnostics": ["do_balance", "do_overlap", "do_diagnose", "do_refute", "do_sensitivity", "do_frame_summary"],
    "graph": ["do_graph_create", "do_graph_drop", "do_graphs", "do_identify", "do_validate"],
    "treatments": ["do_ape", "do_dose_response", "do_ate_levels"],
    "identification": ["do_iv", "do_frontdoor", "do_mediate"],
    "policy": ["do_counterfactual", "do_predict", "do_policy_value", "do_uplift", "do_optimal_policy"],
    "survival": ["do_rmst", "do_rmtl"],
    "panel": ["do_did", "do_event_study", "do_synth", "do_synth_path"],
    "longitudinal": ["do_msm", "do_msm_rmst"],
    "models": ["do_list_models", "do_models", "do_devices", "do_download"],
    "discovery": ["do_discover", "do_discover_dot"],
    "effects": ["do_ate", "do_att", "do_atc", "do_cate", "do_ate_by", "do_ate_pool"],
}


class Engine:
    """Causal operators over DataFrames, tables and queries of a session."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config.of(spark)

    def table(self, rows: list, schema: str) -> DataFrame:
        """A small result; numpy's numbers become plain ones."""
        plain = [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in rows]
        return self.spark.createDataFrame(plain, schema)

    def sql(self, text: str) -> DataFrame:
        from .plans.sql import run

        return run(self, text)


OPERATORS = {}
for _module, _names in _MODULES.items():
    for _name in _names:
        OPERATORS[_name] = getattr(import_module(f"causalith.operators.{_module}"), _name)
        setattr(Engine, _name, OPERATORS[_name])
