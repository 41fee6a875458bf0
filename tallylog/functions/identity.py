"""Event ids and content digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallylog.functions.text import json_document, nul_joined, present
from tallylog.functions.times import format_rfc3339
from tallylog.schema import OPTIONAL_FIELDS, REQUIRED_FIELDS

# Fixed value: prefix of ids made from container log lines.
CONTAINER_ID_PREFIX = "docker-log-"


def journal_event_id(host: Column, boot: Column, unit: Column, cursor: Column) -> Column:
    return F.sha2(nul_joined(host, boot, unit, cursor), 256)


def container_event_id(container: Column, timestamp: Column, message: Column) -> Column:
    digest = F.sha2(nul_joined(container, timestamp, message), 256)
    return F.concat(F.lit(CONTAINER_ID_PREFIX), F.left(digest, F.lit(24)))


def content_digest(
    event_id: Column, env: Column, stream: Column, source: Column,
    ts: Column, ts_sub: Column, canonical_fields: Column,
) -> Column:
    """Digest of the immutable part of a usage event.

    Host, version, level and message are left out, so a retry after an upgrade keeps its digest.
    """
    document = json_document(
        {
            "ID": present(event_id), "Env": present(env), "Stream": present(stream),
            "Source": present(source), "Time": format_rfc3339(ts, ts_sub),
        },
        ("Fields", canonical_fields),
    )
    return F.sha2(document, 256)


def event_json(canonical_fields: Column) -> Column:
    """JSON text of an event row; absent columns and empty fields are omitted."""
    members = {
        "event_id": present(F.col("event_id")),
        "ts": format_rfc3339(F.col("ts"), F.col("ts_sub")),
        **{name: present(F.col(name)) for name in REQUIRED_FIELDS[2:]},
        **{name: F.nullif(F.col(name), F.lit("")) for name in OPTIONAL_FIELDS},
    }
    fields = F.when(~present(canonical_fields).isin("", "{}"), canonical_fields)
    return json_document(members, ("fields", fields))


def receipt_body(sequence: Column, content_sha256: Column, event: Column) -> Column:
    """The stored text of a receipt; digests bind these exact bytes."""
    return F.concat(
        F.lit('{"sequence":"'), sequence.cast("string"), F.lit('","content_sha256":"'),
        content_sha256, F.lit('","event":'), event, F.lit("}"),
    )


def record_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def sealed_status_digest(row: dict[str, Column]) -> Column:
    """Digest of a retirement decision with its own digest field empty.

    ``row`` holds operation_id, environment, store_id, from_sequence, through_sequence,
    plan_sha256, status, completed_at, retired_through and set_id.
    """

    def number(name: str) -> Column:
        return row[name].cast("string")

    document = json_document(
        {
            "operation_id": row["operation_id"],
            "environment": row["environment"],
            "store_id": row["store_id"],
            "from_sequence": number("from_sequence"),
            "through_sequence": number("through_sequence"),
            "plan_sha256": row["plan_sha256"],
            "status": row["status"],
            "receipt_sha256": F.lit(""),
            "completed_at": format_rfc3339(row["completed_at"]),
            "retired_through": number("retired_through"),
            "set_id": row["set_id"],
        }
    )
    return F.sha2(document, 256)
