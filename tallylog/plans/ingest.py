"""Ingest of operational events: route, redact, validate, deduplicate, one result per event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallylog.functions.redact import redact_event
from tallylog.operators.dedupe import first_arrivals, keep_arrivals, unknown_keys
from tallylog.operators.validate import route_reason, with_reject_reason

# Result states.
ACCEPTED, DUPLICATE, REJECTED = "accepted", "duplicate", "rejected"


@dataclass(frozen=True)
class IngestOutcome:
    accepted: DataFrame
    results: DataFrame


def ingest_events(
    events: DataFrame, known: DataFrame | None = None, usage_role: bool = False
) -> IngestOutcome:
    """Accept the first valid arrival of each id that is not in ``known`` (column event_id).

    An invalid event does not reserve its id. Usage rows are for ``append_receipts``; here they
    are rejected unless the role may write them.
    """
    # Redaction cannot blank a message, so rows are judged before it; the result rows and the
    # choice of winners then stay free of it, and only accepted rows are redacted.
    checked = with_reject_reason(events, route_reason(usage_role))
    valid = checked.where(F.col("reject_reason").isNull())
    fresh = first_arrivals(valid)
    if known is not None:
        fresh = unknown_keys(fresh, known)
    accepted = redact_event(keep_arrivals(valid, fresh).drop("reject_reason"))
    results = (
        checked.select("arrival", "event_id", "reject_reason")
        .join(fresh.select("arrival", F.lit(True).alias("_won")), "arrival", "left")
        .select(
            "arrival",
            "event_id",
            F.when(F.col("reject_reason").isNotNull(), REJECTED)
            .when(F.col("_won"), ACCEPTED)
            .otherwise(DUPLICATE)
            .alias("status"),
            F.col("reject_reason").alias("error"),
        )
    )
    return IngestOutcome(accepted, results)


def append_unique(events: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose id is neither stored nor seen earlier in the batch."""
    return keep_arrivals(events, unknown_keys(first_arrivals(events), known))
