"""Text helpers: Unicode-aware trimming, JSON text access and JSON string literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the Unicode White_Space characters; Spark's own trim removes only U+0020.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim(value: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def is_blank(value: Column) -> Column:
    """True for NULL, '' and white space only."""
    return trim(present(value)) == ""


def first_trimmed(*values: Column) -> Column:
    """The first value that is neither NULL nor ''; '' when there is none."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def first_non_empty(*values: Column) -> Column:
    """The first value that is not blank, trimmed; '' when there is none."""
    return first_trimmed(*[trim(v) for v in values])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression.

    Conditional branches are not shared by common-subexpression elimination, so an expensive value
    that is tested and then returned would be computed for each mention. Here it is the variable
    of a one-element transform.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(value: Column) -> Column:
    """NULL becomes ''; hash inputs keep empty parts."""
    return F.coalesce(value, F.lit(""))


def nul_joined(*values: Column) -> Column:
    return F.concat_ws("\0", *[present(v) for v in values])


def parse_strict(text: Column) -> tuple[Column, Column]:
    """Parse one JSON value that must span the whole text.

    Spark's parser stops after the first value, so ``{}{}`` would pass. The text is parsed as the
    first element of an array whose second element is the text's own digest: the digest is read
    back only if nothing follows the value. Returns (variant holder, is valid); read the value
    under the path ``$[0]``.
    """
    digest = F.sha2(text, 256)
    holder = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    valid = F.coalesce(F.try_variant_get(holder, "$[1]", "string") == digest, F.lit(False))
    return holder, valid


def kind_of(variant: Column, path: str) -> Column:
    """Type name of the JSON value at a path; NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def scalar_text(value: Column) -> Column:
    """A JSON string trimmed, a JSON number as its integer part, anything else ''."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double").try_cast("bigint").cast("string")
    return present(
        F.when(kind == "STRING", trim(F.try_variant_get(value, "$", "string"))).when(
            kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number
        )
    )


def scalar_texts(members: Column, names: tuple[str, ...]) -> Column:
    """``scalar_text`` of the named members of a MAP<STRING, VARIANT>, as one map."""
    wanted = F.map_filter(members, lambda name, _: name.isin(*names))
    return F.transform_values(wanted, lambda _, value: scalar_text(value))


# Control characters whose JSON escape has hexadecimal letters.
_LETTER_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")
_NEEDS_ESCAPE = "[<>&\u2028\u2029]|\\\\u00[01][A-F]"


def _escape_document(document: Column) -> Column:
    """Lower-case hex escapes, and ``< > & U+2028 U+2029`` escaped.

    Those characters occur only inside strings, so the whole text is treated at once. JSON text
    holds no raw control character, so one can stand for an escaped backslash meanwhile.
    """
    pairs = [
        ("\\\\", "\x01"),
        *[(f"\\u00{code}", f"\\u00{code.lower()}") for code in _LETTER_ESCAPES],
        ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
        ("\u2028", "\\u2028"), ("\u2029", "\\u2029"), ("\x01", "\\\\"),
    ]
    rendered = document
    for raw, escape in pairs:
        rendered = F.replace(rendered, F.lit(raw), F.lit(escape))
    return F.when(document.rlike(_NEEDS_ESCAPE), rendered).otherwise(document)


def json_document(members: dict[str, Column], tail: tuple[str, Column] | None = None) -> Column:
    """Compact JSON object text; members that are NULL are left out.

    ``tail`` is a last member whose value is JSON text already and is put in unchanged.
    """
    row = F.struct(*[value.alias(name) for name, value in members.items()])
    document = let(F.to_json(row, {"ignoreNullFields": "true"}), _escape_document)
    if tail is None:
        return document
    name, raw = tail
    # The tail goes before the closing brace; a NULL tail leaves just the brace.
    ending = F.coalesce(F.concat(F.lit(f',"{name}":'), raw, F.lit("}")), F.lit("}"))
    opened = let(document, lambda d: F.substr(d, F.lit(1), F.length(d) - 1))
    return F.concat(opened, ending)


def is_digest(value: Column) -> Column:
    """A lower-case hexadecimal SHA-256."""
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_safe_id(value: Column) -> Column:
    """1 to 128 of ``a-z 0-9 - _ .`` and neither ``.`` nor ``..``."""
    return F.coalesce(
        value.rlike(r"\A[a-z0-9_.-]{1,128}\z") & ~value.isin(".", ".."), F.lit(False)
    )
