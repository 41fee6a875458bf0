"""First-wins selection and skew-safe look-ups.

Arrival numbers are unique, so rows are chosen by arrival, never by shuffling whole copies of one
hot event id into one task: the winner of an id is a map-side pre-aggregated minimum, and joining
the winners back on arrival spreads evenly whatever the ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key counts as hot above this share of the rows; there are at most 10 000 such keys.
HOT_SHARE = 1 / 10_000
#: ... and only above this many rows, which is also the size a salt aims for.
HOT_ROWS = 10_000


def first_arrivals(
    df: DataFrame, key: str = "event_id", arrival: str = "arrival", **carried: Column
) -> DataFrame:
    """One row per key: the smallest arrival and the carried values of that row."""
    return df.groupBy(key).agg(
        F.min(arrival).alias(arrival),
        *[F.min_by(value, arrival).alias(name) for name, value in carried.items()],
    )


def keep_arrivals(df: DataFrame, winners: DataFrame, arrival: str = "arrival") -> DataFrame:
    return df.join(winners.select(arrival), arrival, "left_semi")


def first_wins(df: DataFrame, key: str = "event_id", arrival: str = "arrival") -> DataFrame:
    """The earliest row of each key, whole."""
    return keep_arrivals(df, first_arrivals(df, key, arrival), arrival)


def unknown_keys(winners: DataFrame, known: DataFrame, key: str = "event_id") -> DataFrame:
    """Winners whose key is not stored yet. Winners are unique per key, so no key is hot."""
    return winners.join(known.select(key), key, "left_anti")


def salted_lookup(
    rows: DataFrame, facts: DataFrame, key: str, spread: str, how: str = "left"
) -> DataFrame:
    """Join many rows to one fact per key when a few keys hold most of the rows.

    Hot keys are those above ``HOT_SHARE`` of the rows, hence at most 10 000, which is what makes
    broadcasting that list safe. Their rows are spread over salts taken from ``spread`` and their
    fact is repeated once per salt, that is once per ``HOT_ROWS`` rows; all other keys use salt 0.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(
        (F.col("_n") > HOT_ROWS) & (F.col("_n") > total * F.lit(HOT_SHARE))
    ).select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_salts"))
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.when(
            F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")
        ).otherwise(F.lit(0)),
    ).drop("_salts")
    salted_facts = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    ).drop("_salts")
    return salted_rows.join(salted_facts, [key, "_salt"], how).drop("_salt")
