"""Control over how often an expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, whose values later filters and projections reuse.

    The optimizer copies the definition of a column into every filter above it. For costly text
    expressions that multiplies the work; a generated row stops the copying.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
