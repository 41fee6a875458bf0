"""The event schema and the fixed limits shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Field names and their order are part of the data format.
REQUIRED_FIELDS = (
    "event_id", "ts", "level", "msg", "service", "env", "version", "host", "unit", "source",
)
OPTIONAL_FIELDS = (
    "stream", "trace_id", "request_id", "operation_id", "device_id", "org_id", "user_id",
    "component", "error_category", "actor_id", "actor_type", "outcome", "status_code",
    "status_class",
)
#: Names a JSON log message may carry that become columns of their own.
PROMOTED_FIELDS = (
    "level", "msg", "service", "env", "version", "trace_id", "request_id", "operation_id",
    "device_id", "org_id", "user_id", "component", "error_category", "actor_id", "actor_type",
    "outcome", "status_code", "status_class",
)
#: The stream and source marker of metered-usage events.
USAGE_MARKER = "billing_usage"

# Limits.
DEFAULT_QUERY_LIMIT = 100
MAX_QUERY_LIMIT = 1000
MAX_BATCH_BYTES = 10 * 1024 * 1024
MAX_BATCH_EVENTS = 1000
MAX_RECEIPT_EVENT_BYTES = 1024 * 1024
MAX_RECEIPT_ID_BYTES = 4096
MAX_EXPORT_LINE_BYTES = 2 * 1024 * 1024
MAX_PAGE_BYTES = 8 * 1024 * 1024
MAX_PART_BYTES = 256 * 1024 * 1024
MAX_SEALED_PART_BYTES = 272 * 1024 * 1024
MAX_SET_BYTES = 64 * 1024 * 1024 * 1024
MAX_SET_PARTS = 1024
MAX_RANGE_RECEIPTS = 1000
MIN_RETENTION_DAYS = 90
MAX_LONG = 9223372036854775807

#: Event columns: ``ts`` is UTC to the microsecond, ``ts_sub`` the 0-999 ns below it,
#: ``fields`` canonical JSON text, ``arrival`` a unique number that follows arrival order.
EVENT_COLUMNS = {
    "arrival": "bigint",
    "event_id": "string",
    "ts": "timestamp_ntz",
    "ts_sub": "smallint",
    **{name: "string" for name in REQUIRED_FIELDS if name not in ("event_id", "ts")},
    **{name: "string" for name in OPTIONAL_FIELDS},
    "fields": "string",
}


def conform_events(df: DataFrame, *extra: str) -> DataFrame:
    """Project to the event columns, filling absent ones; '' and NULL both mean absent."""

    def column(name: str, kind: str) -> Column:
        if name not in df.columns:
            empty = "0" if name == "ts_sub" else None
            return F.lit(empty).cast(kind).alias(name)
        value = F.col(name).cast(kind)
        if name in OPTIONAL_FIELDS:
            value = F.nullif(value, F.lit(""))
        return value.alias(name)

    return df.select(*[column(n, k) for n, k in EVENT_COLUMNS.items()], *extra)
