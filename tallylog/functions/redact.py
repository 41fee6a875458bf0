"""Secret redaction of messages and of nested JSON fields."""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tallylog.functions.canonical import dump_exact, load_exact

# The replacement text, the text markers and the key names.
REDACTED = "[REDACTED]"
TEXT_MARKERS = (
    "authorization", "bearer ", "password", "secret", "token", "payload", "private key",
    "-----begin",
)
KEY_NAMES = (
    "authorization", "bearer", "token", "cookie", "password", "secret", "dsn", "credential",
    "payload", "private_key", "client_key", "access_key",
)


def _contains_any(text: Column, names: tuple[str, ...]) -> Column:
    """Plain searches: a pattern of alternatives tries each of them at every character."""
    return reduce(or_, [F.contains(text, F.lit(name)) for name in names])


def has_marker(text: Column) -> Column:
    return F.coalesce(_contains_any(F.lower(text), TEXT_MARKERS), F.lit(False))


def redact_text(text: Column) -> Column:
    """The whole value is replaced when it holds any marker, in any case."""
    return F.when(has_marker(text), F.lit(REDACTED)).otherwise(text)


def may_hold_secret(fields: Column) -> Column:
    """Cheap test on the JSON text: no marker, no key name and no escape means nothing to redact.

    An escape (``\\u0070assword``) can hide a marker from a text search, so any row with one is
    looked at in full.
    """
    lowered = F.lower(fields)
    folded = tuple(name for name in KEY_NAMES if "_" in name)
    plain = (set(TEXT_MARKERS) | set(KEY_NAMES) | {"\\u"}) - set(folded)
    return F.coalesce(
        _contains_any(lowered, tuple(sorted(plain)))
        | _contains_any(F.replace(lowered, F.lit("-"), F.lit("_")), folded),
        F.lit(False),
    )


def _text_is_secret(text: str) -> bool:
    lowered = text.lower()
    return any(marker in lowered for marker in TEXT_MARKERS)


@lru_cache(maxsize=4096)
def _key_is_secret(name: str) -> bool:
    folded = name.replace("-", "_").lower()
    return any(item in folded for item in KEY_NAMES)


def _clean(value):
    if isinstance(value, dict):
        return {k: REDACTED if _key_is_secret(k) else _clean(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(item) for item in value]
    if isinstance(value, str) and _text_is_secret(value):
        return REDACTED
    return value


def _clean_document(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return dump_exact(_clean(load_exact(text)))
    except (ValueError, RecursionError):
        return json.dumps({"unparsed": REDACTED}, separators=(",", ":"))


@pandas_udf(StringType())
def _clean_documents(texts: pd.Series) -> pd.Series:
    return texts.map(_clean_document, na_action="ignore")


def redact_fields(fields: Column) -> Column:
    """Redact JSON object text to any depth.

    Only rows that fail the cheap test reach Python; the others pass NULL through the Arrow batch
    and keep their own text.
    """
    return F.coalesce(_clean_documents(F.when(may_hold_secret(fields), fields)), fields)


def redact_event(df: DataFrame) -> DataFrame:
    """Redact ``msg`` and ``fields``; ids and other columns stay as they are."""
    columns = {"msg": redact_text(F.col("msg"))}
    if "fields" in df.columns:
        columns["fields"] = redact_fields(F.col("fields"))
    return df.withColumns(columns)
