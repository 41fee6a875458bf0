"""Request paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallylog.functions.redact import REDACTED
from tallylog.functions.text import let, present

# Fixed value: query parameters whose values are hidden.
SENSITIVE_PARAMETERS = (
    "token", "access_token", "refresh_token", "api_key", "apikey", "password", "client_secret",
)

#: Characters a path may hold unescaped, and a request target that can be parsed at all.
_PATH_OK = r"\A[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/]*\z"
_TARGET_OK = r"\A(?:/|\*\z|[A-Za-z][A-Za-z0-9+.\-]*://)[^\x00-\x1f\x7f]*\z"
_ORIGIN = r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_KEY_VALUE = r"(?i)\b(" + "|".join(SENSITIVE_PARAMETERS) + r")=[^&\s]*"

#: URL-encoded forms that the path encoding leaves as they are.
_PATH_KEEPS = {
    "+": " ", "%2F": "/", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%3A": ":",
    "%3B": ";", "%3D": "=", "%40": "@", "%7E": "~",
}


def _query_escape(text: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped (Java does the opposite)."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _path_escape(path: Column) -> Column:
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    encoded = F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A"))
    for escaped, plain in _PATH_KEEPS.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit("%20" if plain == " " else plain))
    return F.when(path.rlike(_PATH_OK), path).otherwise(encoded)


def _clean_query(query: Column) -> Column:
    """Pairs sorted by key, values of one key in their order, sensitive values hidden."""

    def split_pair(text: Column, index: Column) -> Column:
        at = F.instr(text, "=")
        key = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
        value = F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))
        usable = ~F.contains(text, F.lit(";")) & (text != "")
        return F.struct(
            F.when(usable, F.try_url_decode(key)).alias("key"),
            index.alias("index"),
            F.try_url_decode(value).alias("value"),
        )

    def shown(pair: Column) -> Column:
        hidden = F.lower(pair["key"]).isin(*SENSITIVE_PARAMETERS)
        return F.concat(
            _query_escape(pair["key"]), F.lit("="),
            F.when(hidden, F.lit(REDACTED)).otherwise(_query_escape(pair["value"])),
        )

    pairs = F.filter(
        F.transform(F.split(query, "&"), split_pair),
        lambda p: p["key"].isNotNull() & p["value"].isNotNull(),
    )
    return F.array_join(F.transform(F.array_sort(pairs), shown), "&")


def sanitize_path(target: Column) -> Column:
    """Path and query of a request target with sensitive query values hidden.

    A target that cannot be parsed is kept, but any ``name=value`` of a sensitive name in it is
    still hidden.
    """
    hidden = F.regexp_replace(present(target), _KEY_VALUE, f"$1={REDACTED}")
    return F.when(
        target.rlike(_TARGET_OK),
        F.coalesce(let(F.regexp_replace(target, _ORIGIN, ""), _clean_target), hidden),
    ).otherwise(hidden)


def _clean_target(rest: Column) -> Column:
    """Cleaned path and query; NULL when the path has a broken escape."""
    at = F.instr(rest, "?")
    path = F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)
    query = F.substr(rest, at + 1)
    shown_path = let(
        path,
        lambda p: F.when(p == "", F.lit("/")).when(~p.rlike(_BAD_ESCAPE), _path_escape(p)),
    )
    # A query without one usable pair is kept as it was written.
    shown_query = F.when(at > 0, F.concat(
        F.lit("?"), F.coalesce(F.nullif(let(query, _clean_query), F.lit("")), query)
    )).otherwise(F.lit(""))
    return F.replace(F.concat(shown_path, shown_query), F.lit("%5BREDACTED%5D"), F.lit(REDACTED))


def remote_host(address: Column) -> Column:
    """Host of ``host:port`` or ``[v6]:port``; any other text unchanged."""
    bracketed = r"\A\[([^\[\]]*)\]:[^\[\]:]*\z"
    plain = r"\A([^\[\]:]*):[^\[\]:]*\z"
    return (
        F.when(address.rlike(bracketed), F.regexp_extract(address, bracketed, 1))
        .when(address.rlike(plain), F.regexp_extract(address, plain, 1))
        .otherwise(address)
    )
