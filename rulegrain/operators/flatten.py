"""Arrays to rows.

A plain `explode` of a computed column makes the optimizer add `size(column) > 0` and push it
below the column's own projection, so a costly array (regular expressions, findings) would be
computed twice per row.  The outer form followed by a null filter is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: str, out: str, keep: list[str]) -> DataFrame:
    """One row per (non-null) element."""
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())


def unnest_fields(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    return unnest(df, array, "_item", keep).select(*keep, "_item.*")
