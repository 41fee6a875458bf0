"""Event validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallylog.functions.text import is_blank, present
from tallylog.schema import REQUIRED_FIELDS, USAGE_MARKER

# Reject reasons.
USAGE_ROLE_NEEDED = "billing usage token required"
USAGE_ROLE_ONLY = "billing credential cannot write operational logs"


def missing_field() -> Column:
    """``<field> is required`` for the first blank required field, NULL if all are there."""
    reasons = [
        F.when(
            F.col(name).isNull() if name == "ts" else is_blank(F.col(name)),
            F.lit(f"{name} is required"),
        )
        for name in REQUIRED_FIELDS
    ]
    return F.coalesce(*reasons)


def with_reject_reason(df: DataFrame, *earlier: Column) -> DataFrame:
    """Add ``reject_reason``: the first of the given reasons, then a missing field."""
    return df.withColumn("reject_reason", F.coalesce(*earlier, missing_field()))


def is_usage() -> Column:
    """Either marker makes a row a usage row."""
    return (present(F.col("stream")) == USAGE_MARKER) | (
        present(F.col("source")) == USAGE_MARKER
    )


def route_reason(usage_role: bool) -> Column:
    """Why the caller's role may not write this row; NULL if it may.

    Usage rows need both markers and the usage role; the usage role writes nothing else.
    """
    both = (present(F.col("stream")) == USAGE_MARKER) & (
        present(F.col("source")) == USAGE_MARKER
    )
    if usage_role:
        return F.when(is_usage() & ~both, USAGE_ROLE_NEEDED).when(~is_usage(), USAGE_ROLE_ONLY)
    return F.when(is_usage(), USAGE_ROLE_NEEDED)
