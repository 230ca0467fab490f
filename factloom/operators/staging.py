"""Columns that are worked out exactly once per row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that later filters and joins read instead of recomputing. Catalyst moves
    a filter below a projection by copying the projected expression into it, once per use; it does not
    copy through a generator, so the columns are produced as a one-element inline. The element is a column of its own below
    the generator, as a generator interprets what stands inside it, and the generator an outer one, as Catalyst puts a filter on the
    element's presence, with a copy of it, below any other."""
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.array(made).alias("_made")).select("*", F.inline_outer("_made")).drop("_made")
