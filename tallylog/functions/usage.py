"""Canonical metered-usage events: strict decoding, validation, ids and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallylog.functions.text import (
    first_trimmed, is_digest, json_document, nul_joined, parse_strict, present, trim,
)
from tallylog.functions.times import format_rfc3339, parse_rfc3339, rfc3339_sub
from tallylog.operators.stages import computed_once
from tallylog.schema import MAX_RECEIPT_EVENT_BYTES

# Member names, the id prefix and the metric registry.
TEXT_MEMBERS = ("usage_id", "service_code", "brand_cloud_id", "meter_epoch", "source")
TIME_MEMBERS = ("event_time", "window_start", "window_end")
EVENT_MEMBERS = (*TEXT_MEMBERS, *TIME_MEMBERS, "sequence", "measurements", "dimensions")
MEASUREMENT_MEMBERS = ("metric_code", "unit", "quantity", "quantity_scale")
USAGE_ID_PREFIX = "usage-"
METRIC_REGISTRY = (
    ("mqtt", "publish_bytes", "bytes", 0),
    ("mqtt", "delivery_bytes", "bytes", 0),
    ("mqtt", "publish_count", "requests", 0),
    ("mqtt", "delivery_count", "requests", 0),
    ("ota", "device_task", "tasks", 0),
    ("ota", "successful_download_gib", "GiB", 9),
    ("ota", "artifact_storage_gib_month", "GiB-month", 9),
    ("ota", "artifact_write", "requests", 0),
)


def metric_allowed(service: Column, metric: Column, unit: Column, scale: Column) -> Column:
    entry = nul_joined(service, metric, unit, scale.cast("string"))
    known = ["\0".join(str(part) for part in row) for row in METRIC_REGISTRY]
    return entry.isin(*known)


def decode_usage(df: DataFrame, text: str) -> DataFrame:
    """Add flat ``u_*`` columns and ``usage_malformed`` from strict JSON text.

    Unknown members, wrong types, fractions, integers beyond 64 bits, trailing text and texts
    over 1 MiB are malformed. Times keep their nanoseconds as ``*_sub``.
    """
    source = F.col(text)
    df = computed_once(df, u_holder=parse_strict(source)[0])
    holder = F.col("u_holder")
    measurements = F.try_variant_get(holder, "$[0].measurements", "array<variant>")
    parsed_measurements = F.transform(
        measurements,
        lambda m: F.struct(
            F.try_variant_get(m, "$.metric_code", "string").alias("metric_code"),
            F.try_variant_get(m, "$.unit", "string").alias("unit"),
            F.try_variant_get(m, "$.quantity", "bigint").alias("quantity"),
            F.try_variant_get(m, "$.quantity_scale", "bigint").alias("quantity_scale"),
        ),
    )
    dimensions = F.try_variant_get(holder, "$[0].dimensions", "map<string,variant>")
    df = computed_once(
        df,
        **{
            f"u_{name}": trim(present(F.try_variant_get(holder, f"$[0].{name}", "string")))
            for name in TEXT_MEMBERS
        },
        **{
            f"u_{name}_text": F.try_variant_get(holder, f"$[0].{name}", "string")
            for name in TIME_MEMBERS
        },
        u_sequence=F.coalesce(F.try_variant_get(holder, "$[0].sequence", "bigint"), F.lit(0)),
        u_measurements=F.coalesce(parsed_measurements, F.array()),
        u_dimensions=F.coalesce(
            F.array_sort(
                F.transform(
                    F.map_entries(dimensions),
                    lambda e: F.struct(
                        e["key"].alias("key"),
                        present(F.try_variant_get(e["value"], "$", "string")).alias("value"),
                    ),
                )
            ),
            F.array(),
        ),
        u_typed=_well_typed(source, holder, measurements, dimensions),
    )
    kept = [c for c in df.columns if c not in ("u_holder", "u_measurements")]
    timed = computed_once(
        df,
        kept,
        **{f"u_{name}": parse_rfc3339(F.col(f"u_{name}_text")) for name in TIME_MEMBERS},
        **{f"u_{name}_sub": rfc3339_sub(F.col(f"u_{name}_text")) for name in TIME_MEMBERS},
        u_measurements=F.array_sort(
            F.transform(
                F.col("u_measurements"),
                lambda m: F.struct(
                    present(m["metric_code"]).alias("metric_code"),
                    present(m["unit"]).alias("unit"),
                    F.coalesce(m["quantity"], F.lit(0)).alias("quantity"),
                    F.coalesce(m["quantity_scale"], F.lit(0)).alias("quantity_scale"),
                ),
            )
        ),
    )
    readable = F.col("u_typed") & F.forall("u_measurements", lambda m: m["quantity"] >= 0)
    for name in TIME_MEMBERS:
        readable = readable & (
            F.col(f"u_{name}_text").isNull() | F.col(f"u_{name}").isNotNull()
        )
    return computed_once(timed, usage_malformed=~F.coalesce(readable, F.lit(False))).drop(
        "u_typed", *[f"u_{name}_text" for name in TIME_MEMBERS]
    )


#: Schema text of an event written in full, with plain dimension names. Members come sorted.
_PLAIN_SCHEMA = (
    r"\AOBJECT<brand_cloud_id: STRING, (?:dimensions: OBJECT<(?:\w+: STRING(?:, )?)*>, )?"
    r"event_time: STRING, measurements: ARRAY<OBJECT<metric_code: STRING, quantity: BIGINT, "
    r"(?:quantity_scale: BIGINT, )?unit: STRING>>, meter_epoch: STRING, sequence: BIGINT, "
    r"service_code: STRING, source: STRING, usage_id: STRING, window_end: STRING, "
    r"window_start: STRING>\z"
)


def _well_typed(
    source: Column, holder: Column, measurements: Column, dimensions: Column
) -> Column:
    """One JSON object of known members, each with its JSON type; null stands for absent."""
    whole = F.try_variant_get(holder, "$[1]", "string") == F.sha2(source, 256)
    members = F.try_variant_get(holder, "$[0]", "map<string,variant>")

    def wrong(name: Column, value: Column) -> Column:
        kind = F.schema_of_variant(value)
        fits = (
            F.when(name.isin(*TEXT_MEMBERS, *TIME_MEMBERS), kind == "STRING")
            .when(name == "sequence", kind == "BIGINT")
            .when(name == "measurements", kind.startswith("ARRAY"))
            .when(name == "dimensions", kind.startswith("OBJECT"))
            .otherwise(F.lit(False))
        )
        known = name.isin(*EVENT_MEMBERS)
        return ~F.when(known & (kind == "VOID"), F.lit(True)).otherwise(fits)

    def measurement_wrong(name: Column, value: Column) -> Column:
        kind = F.schema_of_variant(value)
        fits = (
            F.when(name.isin("metric_code", "unit"), kind == "STRING")
            .when(name.isin("quantity", "quantity_scale"), kind == "BIGINT")
            .otherwise(F.lit(False))
        )
        known = name.isin(*MEASUREMENT_MEMBERS)
        return ~F.when(known & (kind == "VOID"), F.lit(True)).otherwise(fits)

    def measurement_ok(m: Column) -> Column:
        inner = F.try_variant_get(m, "$", "map<string,variant>")
        return F.coalesce(F.size(F.map_filter(inner, measurement_wrong)) == 0, F.lit(False))

    # Most events match one schema text; only the others are looked at member by member.
    plain = F.schema_of_variant(F.try_variant_get(holder, "$[0]", "variant")).rlike(_PLAIN_SCHEMA)
    by_member = (
        (F.size(F.map_filter(members, wrong)) == 0)
        & F.coalesce(F.forall(measurements, measurement_ok), F.lit(True))
        & F.coalesce(
            F.forall(
                F.map_values(dimensions), lambda v: F.schema_of_variant(v).isin("STRING", "VOID")
            ),
            F.lit(True),
        )
    )
    return F.coalesce(
        whole
        & (F.octet_length(source) <= MAX_RECEIPT_EVENT_BYTES)
        & (F.coalesce(F.try_variant_get(holder, "$[0].sequence", "bigint"), F.lit(0)) >= 0)
        & F.when(plain, F.lit(True)).otherwise(by_member),
        F.lit(False),
    )


def derived_usage_id() -> Column:
    """Deterministic id over the nanosecond window and the sorted dimensions."""
    dimensions = F.transform(
        "u_dimensions", lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    head = nul_joined(
        F.col("u_service_code"), F.col("u_brand_cloud_id"), F.col("u_meter_epoch"),
        F.col("u_sequence").cast("string"),
        format_rfc3339(F.col("u_window_start"), F.col("u_window_start_sub")),
        format_rfc3339(F.col("u_window_end"), F.col("u_window_end_sub")),
    )
    text = F.array_join(F.concat(F.array(head), dimensions), "\0")
    return F.concat(F.lit(USAGE_ID_PREFIX), F.left(F.sha2(text, 256), F.lit(24)))


def usage_reason() -> Column:
    """Why a decoded usage event is invalid, NULL if it is valid.

    The window must be non-empty after truncation to microseconds, which implies it was before.
    """
    metrics = F.transform("u_measurements", lambda m: m["metric_code"])
    needed = [F.col(f"u_{n}") for n in ("service_code", "brand_cloud_id", "meter_epoch", "source")]
    complete = (
        F.octet_length("usage_id").between(1, 128)
        & F.col("u_event_time").isNotNull()
        & (F.col("u_window_end") > F.col("u_window_start"))
        & (F.size("u_measurements") > 0)
    )
    for value in needed:
        complete = complete & (value != "")
    known = (F.size(F.array_distinct(metrics)) == F.size(metrics)) & F.forall(
        "u_measurements",
        lambda m: metric_allowed(
            F.col("u_service_code"), m["metric_code"], m["unit"], m["quantity_scale"]
        ),
    )
    return (
        F.when(F.col("usage_malformed"), "malformed")
        .when(~F.coalesce(complete, F.lit(False)), "invalid_event")
        .when(~F.coalesce(known, F.lit(False)), "invalid_measurement")
    )


def usage_digest() -> Column:
    """Digest of the canonical usage JSON with microsecond times and sorted measurements."""

    measurements = F.transform(
        "u_measurements",
        lambda m: F.struct(
            m["metric_code"].alias("metric_code"), m["unit"].alias("unit"),
            m["quantity"].alias("quantity"),
            F.nullif(m["quantity_scale"], F.lit(0)).alias("quantity_scale"),
        ),
    )
    dimensions = F.when(F.size("u_dimensions") > 0, F.map_from_entries("u_dimensions"))
    document = json_document(
        {
            "usage_id": F.col("usage_id"),
            "service_code": F.col("u_service_code"),
            "brand_cloud_id": F.col("u_brand_cloud_id"),
            **{name: format_rfc3339(F.col(f"u_{name}")) for name in TIME_MEMBERS},
            "meter_epoch": F.col("u_meter_epoch"),
            "sequence": F.col("u_sequence"),
            "source": F.col("u_source"),
            "measurements": measurements,
            "dimensions": dimensions,
        }
    )
    return F.sha2(document, 256)


def canonical_usage(df: DataFrame, text: str) -> DataFrame:
    """Decode, validate and digest: adds ``u_*`` columns, ``usage_id``, ``usage_reason`` and
    ``event_sha256`` (NULL when invalid)."""
    decoded = decode_usage(df, text)
    named = computed_once(decoded, usage_id=first_trimmed(F.col("u_usage_id"), derived_usage_id()))
    judged = computed_once(named, usage_reason=usage_reason())
    digest = F.when(F.col("usage_reason").isNull(), usage_digest())
    return computed_once(judged, event_sha256=digest).drop("usage_malformed")


def usage_bindings(
    df: DataFrame, text: str, sequence: str = "sequence", digest: str = "content_sha256"
) -> DataFrame:
    """Consumer reconciliation rows; ``binding_reason`` is NULL for the usable ones."""
    out = canonical_usage(df, text)
    bad_record = ~F.coalesce(F.col(sequence) > 0, F.lit(False)) | ~is_digest(F.col(digest))
    return out.withColumn(
        "binding_reason",
        F.when(bad_record, "invalid_record").otherwise(F.col("usage_reason")),
    )


def usage_facts(df: DataFrame) -> DataFrame:
    """One row per measurement of each valid usage event of ``canonical_usage``."""
    return (
        df.where(F.col("usage_reason").isNull())
        .select(
            "usage_id",
            *[F.col(f"u_{n}").alias(n) for n in ("service_code", "brand_cloud_id", "meter_epoch")],
            F.col("u_sequence").alias("usage_sequence"),
            *[F.col(f"u_{n}").alias(n) for n in ("window_start", "window_end")],
            F.inline("u_measurements"),
        )
    )
