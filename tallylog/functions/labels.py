"""The low-cardinality label set an event is stored under."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallylog.functions.text import kind_of, present

# Device sources, retention days and the policy label.
DEVICE_SOURCES = ("device-runtime", "device-legacy")
RETENTION_DAYS = (7, 30, 90)
RETENTION_FIELD = "retention_days_snapshot"
RETENTION_POLICY = "product-grant-v1"


def retention_tier(source: Column, fields: Column) -> Column:
    """``7d``, ``30d`` or ``90d`` for device events whose snapshot is that exact JSON integer."""
    applies = source.isin(*DEVICE_SOURCES) & F.contains(fields, F.lit(f'"{RETENTION_FIELD}"'))
    document = F.try_parse_json(F.when(applies, fields))
    path = f"$.{RETENTION_FIELD}"
    days = F.when(
        kind_of(document, path) == "BIGINT", F.try_variant_get(document, path, "bigint")
    )
    return F.when(applies & days.isin(*RETENTION_DAYS), F.concat(days.cast("string"), F.lit("d")))


def retention_policy(tier: Column) -> Column:
    return F.when(tier.isNotNull(), F.lit(RETENTION_POLICY))


def _members(tier: Column) -> list[tuple[str, Column]]:
    """Label names in byte order with their values; a NULL value means no label."""
    return [
        *[(name, present(F.col(name))) for name in ("env", "host", "level")],
        ("retention_policy", retention_policy(tier)),
        ("retention_tier", tier),
        ("service", present(F.col("service"))),
        ("stream", F.nullif(F.col("stream"), F.lit(""))),
        ("unit", present(F.col("unit"))),
    ]


def label_set(tier: Column) -> Column:
    entries = [x for name, value in _members(tier) for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def label_key(tier: Column) -> Column:
    """Text key of the label set: sorted names and values joined by NUL."""
    return F.concat_ws(
        "\0", *[F.concat(F.lit(name + "\0"), value) for name, value in _members(tier)]
    )
