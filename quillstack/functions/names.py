"""Names of temporary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str, *more: DataFrame) -> str:
    """A column name that none of the tables has (Spark's names ignore case)."""
    taken = {c.lower() for d in (df, *more) for c in d.columns}
    while name.lower() in taken:
        name += "_"
    return name
