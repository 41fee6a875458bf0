"""Canonical JSON text: sorted keys, number text kept as written, fixed escapes."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from tallylog.functions.text import parse_strict


class _Number(str):
    """A JSON number kept as its source text."""


def load_exact(text: str):
    return json.loads(
        text, parse_int=_Number, parse_float=_Number, parse_constant=_reject_constant
    )


def _reject_constant(name: str):
    raise ValueError(f"not JSON: {name}")


_DECODER = json.JSONDecoder(
    parse_int=_Number, parse_float=_Number, parse_constant=_reject_constant
)
_ESCAPES = str.maketrans(
    {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
)
_SURROGATE = re.compile("[\ud800-\udfff]")


def _quote(text: str) -> str:
    text = _SURROGATE.sub("\ufffd", text)  # a lone surrogate has no UTF-8 form
    return json.dumps(text, ensure_ascii=False).translate(_ESCAPES)


def dump_exact(value) -> str:
    if isinstance(value, _Number):
        return str.__str__(value)
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quote(k)}:{dump_exact(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump_exact, value)) + "]"
    return json.dumps(value)


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return dump_exact(load_exact(text))
    except (ValueError, RecursionError):
        return None


@pandas_udf(StringType())
def _canonical_documents(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical, na_action="ignore")


#: What stands before a number that is a value: the colon of a name, a comma or a bracket. A colon
#: alone is not enough, since texts of times have it. Strings start with a quote.
_BEFORE = r'[",\[](?:(?<=")\s*:|(?<!"))\s*-?'
#: A number whose text Spark's JSON functions may change: a fraction, an exponent, a negative zero
#: or more than 18 digits.
_INEXACT = r"(?:[0-9]+[.eE]|[0-9]{19}|0\b(?<=-0))"


def _holds_number(text: Column, number: str) -> Column:
    # The comma stands for the start of the text.
    return F.concat(F.lit(","), text).rlike(_BEFORE + number)


def has_inexact_number(text: Column) -> Column:
    """Whether JSON text may have such a number; a string with a comma before one counts too."""
    return _holds_number(text, _INEXACT)


def _is_hard(text: Column) -> Column:
    """Text whose canonical form Spark's own parser does not give: such a number, any escape, any
    character that needs one, or one outside the basic plane.

    Plain searches come first, and wide characters are looked at only where there are some.
    """
    found = F.octet_length(text) != F.char_length(text)
    found = found & text.rlike(r"[\x{2028}\x{2029}\x{10000}-\x{10FFFF}]")
    for mark in "\\<>&":
        found = found | F.contains(text, F.lit(mark))
    return found | has_inexact_number(text)


def canonical_json(text: Column) -> Column:
    """Canonical JSON; NULL where the text is not JSON.

    Plain documents are sorted inside the JVM; only the hard ones go through Arrow.
    """
    hard = F.coalesce(_is_hard(text), F.lit(False))
    holder, whole = parse_strict(F.when(~hard, text))
    native = F.when(whole, F.to_json(F.try_variant_get(holder, "$[0]", "variant")))
    return F.coalesce(native, _canonical_documents(F.when(hard, text)))


#: A number that may be written in another way than a 64-bit number is: a fraction, an exponent, or
#: more digits than such a number holds.
_OTHER_SPELLING = r"(?:[0-9]+[.eE]|[0-9]{16})"
_STRING_OR_NUMBER = re.compile(r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?', re.S)


def shortest_number(text: str) -> str:
    """A JSON number as the shortest text of its 64-bit value: plain from 1e-6 up to 1e21, else with
    an exponent without leading zeros. One beyond that range keeps its text."""
    value = float(text)
    if math.isinf(value):
        return text
    if value == 0:
        return "-0" if text.startswith("-") else "0"
    exact = Decimal(repr(value)).normalize()
    if 1e-6 <= abs(value) < 1e21:
        return format(exact, "f")
    sign, digits, _ = exact.as_tuple()
    exponent = exact.adjusted()
    first, rest = str(digits[0]), "".join(map(str, digits[1:]))
    return f"{'-' if sign else ''}{first}{'.' + rest if rest else ''}e{'+' if exponent > 0 else ''}{exponent}"


def _respelled(text: str) -> str:
    return _STRING_OR_NUMBER.sub(
        lambda m: m[0] if m[0][0] == '"' else shortest_number(m[0]), text)


@pandas_udf(StringType())
def _respelled_documents(texts: pd.Series) -> pd.Series:
    return texts.map(_respelled, na_action="ignore")


def shortest_numbers(text: Column) -> Column:
    """JSON text with all its numbers as ``shortest_number``; the rest stays as it is.

    Only texts with another spelling go through Arrow.
    """
    other = F.coalesce(_holds_number(text, _OTHER_SPELLING), F.lit(False))
    return F.coalesce(_respelled_documents(F.when(other, text)), text)


def _event_fields(body: str | None) -> list[str | None] | None:
    if body is None:
        return None
    try:
        document, _ = _DECODER.raw_decode(body.lstrip(" \t\r\n"))
        fields = [(event or {}).get("fields") for event in document.get("events") or []]
        return [None if value is None else dump_exact(value) for value in fields]
    except (ValueError, AttributeError, RecursionError):
        return None


@pandas_udf(ArrayType(StringType()))
def exact_event_fields(bodies: pd.Series) -> pd.Series:
    """Canonical ``fields`` of every event of a batch document, for bodies with inexact numbers."""
    return bodies.map(_event_fields, na_action="ignore")
