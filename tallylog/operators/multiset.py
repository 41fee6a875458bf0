"""Additive fingerprints: a table's rows as a multiset, whatever their order and batches.

Each row has a SHA-256 digest, read as eight 32-bit words; the fingerprint is the number of rows and
the sum of each word. Sums are pre-aggregated in tasks, so a table of any size costs one narrow scan
and moves one row a task; and fingerprints of batches add up to that of their union, so a growing
table is never read again. The sums are exact decimals, wide enough for 10^27 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = [f"w{i}" for i in range(8)]


def row_digest(columns: list[str]) -> Column:
    """Digest of a row's columns as text: each value with its length, so that none runs into the
    next, and NULL apart from every text."""
    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(
            F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("N"))

    return F.sha2(F.concat(*[told(c) for c in columns]), 256)


def fingerprint(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group): n and the sums of the words of all row digests."""
    digests = rows.select(*by, row_digest(columns).alias("_d"))
    return digests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.coalesce(F.sum(
                F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)")
            ).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(word)
            for i, word in enumerate(WORDS)
        ],
    )


def combined(parts: DataFrame) -> DataFrame:
    """One row: the fingerprint of the union of the parts' rows."""
    zero = F.lit(0).cast("decimal(38,0)")
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(w).cast("decimal(38,0)"), zero).alias(w) for w in WORDS],
    )


def without(whole: DataFrame, part: DataFrame) -> DataFrame:
    """One row: the fingerprint of a table after rows with the fingerprint ``part`` left it."""
    negative = part.select(
        (-F.col("n")).alias("n"), *[(-F.col(w)).cast("decimal(38,0)").alias(w) for w in WORDS])
    return combined(whole.select("n", *WORDS).unionByName(negative))


def as_text() -> Column:
    """The fingerprint of a row as text, to be kept and compared."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", *WORDS)])
