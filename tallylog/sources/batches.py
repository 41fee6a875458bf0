"""Ingest batches: ``{"events": [...]}`` documents, from requests or queued files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallylog.functions.canonical import canonical_json, exact_event_fields, has_inexact_number
from tallylog.functions.text import parse_strict
from tallylog.functions.times import parse_rfc3339, rfc3339_sub
from tallylog.operators.stages import computed_once
from tallylog.schema import (
    MAX_BATCH_BYTES, MAX_BATCH_EVENTS, OPTIONAL_FIELDS, REQUIRED_FIELDS, conform_events,
)

_TEXT_FIELDS = (*[n for n in REQUIRED_FIELDS if n != "ts"], *OPTIONAL_FIELDS)
#: Every member is read as text. Number text inside ``fields`` is kept except for fractions,
#: exponents and very long numbers; bodies with those have their fields read by an Arrow function.
_BODY_SCHEMA = (
    "events array<struct<ts string, fields string, "
    + ", ".join(f"{name} string" for name in _TEXT_FIELDS)
    + ">>"
)


def read_batches(spark: SparkSession, path: str, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Whole files as (path, body); a batch is at most ``MAX_BATCH_BYTES``.

    A larger file is listed with a NULL body, which ``check_batches`` refuses as too large: its
    size is tested before its content is read.
    """
    scan = spark.read.text(path, wholetext=True)
    size, file = F.col("_metadata.file_size"), F.col("_metadata.file_path").alias("path")
    listed = spark.read.format("binaryFile").load(path)
    large = listed.where(F.col("length") > max_bytes).select(
        "path", F.lit(None).cast("string").alias("body"))
    return scan.where(size <= max_bytes).select(file, F.col("value").alias("body")).unionByName(large)


def check_batches(
    batches: DataFrame, max_bytes: int = MAX_BATCH_BYTES, max_events: int = MAX_BATCH_EVENTS
) -> DataFrame:
    """Add ``batch_error`` (NULL when usable), ``event_count`` and the parsed ``events``.

    Fixed reasons, in the order they are tested: ``request body too large``, ``invalid json``,
    ``too many events``, ``invalid trailing json``. A NULL body stands for one that was too large to
    be read.
    """
    small = F.when(F.octet_length("body") <= max_bytes, F.col("body"))
    df = computed_once(batches, _alone=F.try_parse_json(small), _holder=parse_strict(small)[0])
    whole = F.coalesce(
        F.try_variant_get("_holder", F.lit("$[1]"), "string") == F.sha2("body", 256),
        F.lit(False),
    )
    root = F.schema_of_variant("_alone")
    listed = F.schema_of_variant(F.try_variant_get("_alone", F.lit("$.events"), "variant"))
    elements = F.try_variant_get("_alone", F.lit("$.events"), "array<variant>")

    def mistyped(name: Column, value: Column) -> Column:
        kind = F.schema_of_variant(value)
        text = name.isin(*_TEXT_FIELDS) & ~kind.isin("STRING", "VOID")
        time = (name == "ts") & (kind != "VOID") & ~F.coalesce(
            parse_rfc3339(F.try_variant_get(value, "$", "string")).isNotNull()
            & (kind == "STRING"),
            F.lit(False),
        )
        return text | time | ((name == "fields") & ~kind.rlike("^(OBJECT|VOID)"))

    def well_formed(element: Column) -> Column:
        """An object whose members have their types, or null, which is an empty event."""
        members = F.try_variant_get(element, "$", "map<string,variant>")
        typed = F.size(F.map_filter(members, mistyped)) == 0
        return F.when(F.schema_of_variant(element) == "VOID", F.lit(True)).otherwise(
            F.coalesce(typed & members.isNotNull(), F.lit(False))
        )

    shaped = root.rlike("^(OBJECT|VOID)") & (
        listed.isNull()
        | (listed == "VOID")
        | F.coalesce(listed.startswith("ARRAY") & F.forall(elements, well_formed), F.lit(False))
    )
    events = F.coalesce(F.from_json(small, _BODY_SCHEMA)["events"], F.array())
    error = (
        F.when(F.coalesce(F.octet_length("body") > max_bytes, F.lit(True)), "request body too large")
        .when(~F.coalesce(shaped, F.lit(False)), "invalid json")
        .when(F.size("events") > max_events, "too many events")
        .when(~whole, "invalid trailing json")
    )
    df = computed_once(df, events=events)
    df = computed_once(df, event_count=F.size("events"), batch_error=error)
    return df.drop("_alone", "_holder")


def batch_events(checked: DataFrame, order: str) -> DataFrame:
    """Event rows of the usable batches; ``arrival`` is batch order, then list position.

    ``order`` is a BIGINT column that orders the batches; a batch has at most 2^20 events.
    """
    usable = checked.where(F.col("batch_error").isNull())
    inexact = F.when(has_inexact_number(F.col("body")), F.col("body"))
    rows = usable.withColumn("_exact", exact_event_fields(inexact)).select(
        order, "_exact", F.posexplode("events").alias("position", "event")
    )

    df = rows.withColumns(
        {
            "arrival": F.col(order) * (1 << 20) + F.col("position"),
            "ts": parse_rfc3339(F.col("event.ts")),
            "ts_sub": rfc3339_sub(F.col("event.ts")),
            **{name: F.col(f"event.{name}") for name in _TEXT_FIELDS},
            "fields": F.coalesce(
                F.get("_exact", F.col("position")), canonical_json(F.col("event.fields"))
            ),
        }
    )
    return conform_events(df)


def quarantine(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable queued batches, unreadable ones); the readable ones are replayed in path order."""
    checked = check_batches(batches)
    bad = F.coalesce(
        F.col("batch_error").isin("invalid json", "invalid trailing json"), F.lit(False)
    )
    return checked.where(~bad), checked.where(bad).drop("events")
