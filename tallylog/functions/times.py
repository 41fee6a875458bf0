"""RFC 3339 times with nanoseconds as (microsecond TIMESTAMP_NTZ, 0-999 ns remainder)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
_BELOW_MICROS = r"[.,]\d{6}(\d{1,3})"


def parse_rfc3339(text: Column) -> Column:
    """UTC time to the microsecond, NULL if the text is not RFC 3339.

    The pattern fixes the shape; Spark's cast then checks the fields and drops further digits.
    """
    moment = F.translate(text, ",", ".").try_cast("timestamp").cast("timestamp_ntz")
    return F.when(text.rlike(_RFC3339), moment)


def rfc3339_sub(text: Column) -> Column:
    """The 0-999 ns below the microsecond of an RFC 3339 text."""
    digits = F.rpad(F.regexp_extract(text, _BELOW_MICROS, 1), 3, "0")
    return F.coalesce(digits.try_cast("smallint"), F.lit(0).cast("smallint"))


def format_rfc3339(ts: Column, sub: Column | None = None) -> Column:
    """UTC text with trailing zeros of the fraction removed."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    digits = F.concat(seconds, F.lpad(sub.cast("string"), 3, "0")) if sub is not None else seconds
    # Zeros end at the point at the latest, so only fraction digits are removed.
    return F.concat(F.rtrim(F.rtrim(digits, F.lit("0")), F.lit(".")), F.lit("Z"))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal from ``yyyy-MM-dd HH:mm:ss[.ffffff]``."""
    return F.lit(text).cast("timestamp_ntz")
