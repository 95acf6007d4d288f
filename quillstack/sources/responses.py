"""Answers of search and model services as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS = "array<array<string>>"


def search_rows(body: Column) -> Column:
    """Rows of a search response in any of its shapes: result.data_array, result, data, rows or a bare list."""
    shapes = ["result struct<data_array array<array<string>>>", f"result {_ROWS}", f"data {_ROWS}", f"rows {_ROWS}"]
    found = [F.from_json(body, shapes[0])["result"]["data_array"], *(F.from_json(body, s)[s.split()[0]] for s in shapes[1:]), F.from_json(body, _ROWS)]
    return F.coalesce(*found, F.array().cast(_ROWS))


def parse_search(responses: DataFrame, columns: list[str], body: str = "body") -> DataFrame:
    """One row per result, named by ``columns`` and a trailing score; rows that are too short are dropped."""
    keep = [c for c in responses.columns if c != body]
    rows = responses.select(*keep, F.posexplode(search_rows(F.col(body))).alias("rank", "_r")).filter(F.size("_r") >= len(columns))
    return rows.select(*keep, "rank", *[F.get("_r", F.lit(i)).alias(c) for i, c in enumerate(columns)], F.get("_r", F.lit(len(columns))).try_cast("double").alias("score"))


def unwrap_prediction(body: Column, schema: str) -> Column:
    """The prediction of {"predictions": {..}}, {"predictions": [{..}]}, [{..}] or {..}."""
    one, many = F.from_json(body, f"predictions {schema}")["predictions"], F.from_json(body, f"predictions array<{schema}>")["predictions"]
    listed = F.from_json(body, f"array<{schema}>")
    is_list = F.ltrim(body).startswith("[")
    wrapped = F.get_json_object(body, "$.predictions")
    return F.when(is_list, F.get(listed, F.lit(0))).when(F.ltrim(wrapped).startswith("["), F.get(many, F.lit(0))).when(wrapped.isNotNull(), one).otherwise(F.from_json(body, schema))


def to_store(columns: list[str]) -> Column:
    """Columns as a JSON object, as kept in a browser's store."""
    return F.to_json(F.struct(*columns))


def from_store(body: Column, schema: str) -> Column:
    return F.from_json(body, schema)
