"""The corpus queries and their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

#: Query name: module of this package that holds the function of that name.
_MODULES = {
    "op1_media": "media",
    "op2_url_filter": "url_filter",
    "op3_packing": "packing",
    "op4_quality": "quality",
    "op5_near_dedup": "near_dedup",
    "op6_sharding": "sharding",
    "op7_decontamination": "decontamination",
    "op8_main_text": "html_text",
    "op9_suffix_dedup": "repeats",
    "op10_language_model": "language_model",
}

QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}

ORACLE_SQL: dict[str, str] = {}
for _module in dict.fromkeys(_MODULES.values()):
    ORACLE_SQL |= getattr(import_module(f"{__package__}.{_module}"), "ORACLE_SQL", {})
