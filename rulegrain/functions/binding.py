"""Naming an intermediate value inside an expression.

Expressions used several times inside a higher-order function are evaluated each time; binding
them to a lambda variable evaluates them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
