"""Evaluation boundaries between steps of a projection pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Add columns whose values later steps reuse.

    Catalyst merges neighbouring projections and pushes filters through them by repeating the
    expressions, so a parsed document that ten later columns use can be parsed dozens of times.
    Here a compiled projection builds one struct per row, and a generator of exactly one row
    spreads it: no rule merges or pushes anything through that, so each value is computed once.
    """
    kept = df.columns if keep is None else keep
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, row.alias("_row")).select(*kept, F.inline(F.array("_row")))
