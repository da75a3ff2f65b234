"""Settings of an engine, with the defaults that apply where a setting is unset or not positive."""

from __future__ import annotations

from dataclasses import dataclass, fields

PREFIX = "spark.causalith."


@dataclass(frozen=True)
class Config:
    default_estimator: str = "aipw"
    max_rows: int = 1_000_000_000_000
    max_memory: str = ""
    max_features: int = 500
    max_categorical_levels: int = 32
    max_groups: int = 1000
    model_dir: str = ""
    device: str = "cpu"
    gpu_precision: str = "fp32"
    threads: int = 0
    ensemble_draws: int = 1
    query_chunk: int = 512
    seed: int = 42
    bootstrap_reps: int = 200
    #: Groups of do_ate_by with at most so many rows are fitted in one task each, larger ones across tasks.
    group_rows: int = 200_000

    @classmethod
    def of(cls, spark) -> Config:
        """The session's settings: ``spark.causalith.max_rows`` and so on. Rows are not held in memory, so the row cap is high."""
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(PREFIX + f.name, None)
            if raw is not None:
                value = int(raw) if f.type == "int" else raw
                if f.type != "int" or value > 0:
                    found[f.name] = value
        return cls(**found)
