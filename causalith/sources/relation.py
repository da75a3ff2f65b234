"""What a relation argument may be: a DataFrame, a table's name, or a query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import CausalError


def resolve(spark: SparkSession, relation) -> DataFrame:
    if isinstance(relation, DataFrame):
        return relation
    text = str(relation).strip()
    if re.match(r"(?is)\(?\s*(select|with|from|values)\b", text) or text.startswith("("):
        return spark.sql(text)
    if re.fullmatch(r'(?:[A-Za-z_]\w*|`[^`]+`|"[^"]+")(?:\.(?:[A-Za-z_]\w*|`[^`]+`|"[^"]+")){0,2}', text):
        return spark.table(text.replace('"', "`"))
    raise CausalError(f"the relation must be a table name or a query: {text[:60]}")


def column(df: DataFrame, name: str) -> str:
    """The column's own spelling; names are matched without case."""
    for c in df.columns:
        if c.lower() == str(name).lower():
            return c
    raise CausalError(f'column "{name}" not found; the relation has {", ".join(df.columns)}')
