"""Small constant tables as inline VALUES, so the optimizer sees a local relation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def literal(value, kind: T.DataType) -> str:
    """SQL literal of the given type."""
    if value is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    if isinstance(kind, T.StringType):
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST('{value}' AS {kind.simpleString()})"


def inline_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    body = ", ".join("(" + ", ".join(literal(v, f.dataType) for v, f in zip(row, schema.fields))
                     + ")" for row in rows)
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def struct_literal(value: dict, schema: T.StructType) -> str:
    """One row as a named_struct expression."""
    parts = ", ".join(f"'{f.name}', {literal(value.get(f.name), f.dataType)}"
                      for f in schema.fields)
    return f"named_struct({parts})"
