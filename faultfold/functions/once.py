"""Computing a column once when much depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters cannot duplicate.

    Catalyst pushes a filter below a projection by putting the projected expressions in its place,
    so a costly expression, such as a JSON parse behind a chain of checks, would be evaluated many
    times over. A filter is not pushed through a generator; this one yields one row per row and
    stays inside generated code.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(made)))
