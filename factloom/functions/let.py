"""Evaluate a sub-expression once per row."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once: a column used many times inside a deep expression is
    otherwise repeated in the plan at every use, and the copies multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
