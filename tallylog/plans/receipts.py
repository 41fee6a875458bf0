"""The usage-receipt table: append, conflict detection, paging, hot and cached bodies."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallylog.functions.canonical import canonical_json
from tallylog.functions.identity import (
    content_digest, event_json, receipt_body, record_digest,
)
from tallylog.functions.redact import redact_fields, redact_text
from tallylog.functions.text import present
from tallylog.functions.times import ntz
from tallylog.operators.dedupe import first_arrivals, salted_lookup
from tallylog.operators.packing import pack_greedy
from tallylog.operators.scan import BLOCK, dense_sequence
from tallylog.operators.stages import computed_once
from tallylog.operators.validate import missing_field
from tallylog.plans.ingest import ACCEPTED, DUPLICATE, REJECTED
from tallylog.schema import (
    MAX_PAGE_BYTES, MAX_QUERY_LIMIT, MAX_RECEIPT_EVENT_BYTES, MAX_RECEIPT_ID_BYTES,
    USAGE_MARKER,
)
from tallylog.session import checkpointed
from tallylog.sources.receipts import RECEIPT_SCHEMA, bindings_of
from tallylog.sources.tables import BatchTable

# Reject reasons.
NEEDS_ENVELOPE = "billing usage envelope required"
BAD_FIELDS = "invalid billing fields"
TOO_LARGE = "invalid or oversized billing event"
NEEDS_REDACTION = "billing usage fields must not require redaction"
IDENTITY_CONFLICT = "billing event identity conflicts with stored content"


def usage_envelope(events: DataFrame) -> DataFrame:
    """Add canonical ``fields``, the event text ``_event`` and ``reject_reason`` of usage rows."""
    df = events.withColumn("_canonical", canonical_json(F.col("fields")))
    # The exact text of the member: NULL when absent or JSON null.
    usage_event = F.from_json("_canonical", "usage_event string")["usage_event"]
    df = computed_once(df, usage_event=usage_event, _event=event_json(F.col("_canonical")))
    envelope = (
        (present(F.col("stream")) == USAGE_MARKER)
        & (present(F.col("source")) == USAGE_MARKER)
        & (F.col("fields").isNotNull())
    )
    oversized = (F.octet_length("_event") > MAX_RECEIPT_EVENT_BYTES) | (
        F.octet_length("event_id") > MAX_RECEIPT_ID_BYTES
    )
    # Changed by redaction exactly when the redacted text differs.
    df = df.withColumn("_redacted", redact_fields(F.col("_canonical")))
    reason = F.coalesce(
        missing_field(),
        F.when(~envelope, NEEDS_ENVELOPE),
        F.when(F.col("_canonical").isNull(), BAD_FIELDS),
        F.when(F.col("usage_event").isNull(), NEEDS_ENVELOPE),
        F.when(oversized, TOO_LARGE),
        F.when(F.col("_redacted") != F.col("_canonical"), NEEDS_REDACTION),
    )
    return computed_once(df, reject_reason=reason).drop("_redacted")


@dataclass(frozen=True)
class AppendOutcome:
    #: New receipts in ``RECEIPT_SCHEMA`` order.
    receipts: DataFrame
    #: One row per event: arrival, event_id, status, error.
    results: DataFrame
    #: Number of the new receipts, which follow the head without a gap.
    count: int


def append_receipts(
    events: DataFrame,
    bindings: DataFrame,
    head: int,
    received_at: str,
    block: int = BLOCK,
) -> AppendOutcome:
    """Give each new usage event the next gap-free sequence number, in arrival order.

    The same id with the same content is a duplicate, with other content a conflict; the first
    stored content wins. Arrivals must be unique. ``bindings`` holds (event_id, content_sha256) of stored receipts and
    ``head`` their highest sequence.
    """
    checked = usage_envelope(events)
    digest = content_digest(
        F.col("event_id"), F.col("env"), F.col("stream"), F.col("source"),
        F.col("ts"), F.col("ts_sub"), F.col("_canonical"),
    )
    # Parsing and digests are the dear steps, so their rows are written once; what becomes of a row
    # is then decided on four narrow columns.
    digested = checkpointed(computed_once(
        checked, content_sha256=F.when(F.col("reject_reason").isNull(), digest)
    ).drop("_event"))
    judged = digested.select("arrival", "event_id", "content_sha256", "reject_reason")
    repeated = judged.groupBy("arrival").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError("arrivals must be unique: equal ones would share a sequence number")
    narrow = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")

    # One row per id: the first arrival of this batch and the stored digest, if any.
    firsts = first_arrivals(narrow, first_digest=F.col("content_sha256"))
    stored = bindings.select("event_id", F.col("content_sha256").alias("stored_digest"))
    bound = checkpointed(firsts.join(stored, "event_id", "left").select(
        "event_id",
        F.col("arrival").alias("first_arrival"),
        F.coalesce("stored_digest", "first_digest").alias("bound_digest"),
        F.col("stored_digest").isNotNull().alias("is_stored"),
    ))

    fresh = bound.where(~F.col("is_stored")).select(F.col("first_arrival").alias("arrival"))
    numbered = dense_sequence(fresh, "arrival", "sequence", head, block)
    body = receipt_body(F.col("sequence"), F.col("content_sha256"), F.col("_event"))
    # The stored event carries the redacted message; ``_event`` is rendered again from it.
    rows = computed_once(
        digested.withColumn("msg", redact_text(F.col("msg"))),
        _event=event_json(F.col("_canonical")),
    )
    receipts = (
        computed_once(rows.join(numbered, "arrival"), body=body)
        .select(
            "sequence", "event_id", "env", "content_sha256",
            record_digest(F.col("body")).alias("record_sha256"),
            ntz(received_at).alias("received_at"),
            F.lit(False).alias("is_legacy"),
            "body",
        )
    )

    known = salted_lookup(narrow, bound, "event_id", "arrival", "inner").select(
        "arrival",
        "event_id",
        F.when(~F.col("is_stored") & (F.col("arrival") == F.col("first_arrival")), ACCEPTED)
        .when(F.col("content_sha256") == F.col("bound_digest"), DUPLICATE)
        .otherwise(REJECTED)
        .alias("status"),
    )
    known = known.withColumn("error", F.when(F.col("status") == REJECTED, IDENTITY_CONFLICT))
    rejected = judged.where(F.col("reject_reason").isNotNull()).select(
        "arrival", "event_id", F.lit(REJECTED).alias("status"),
        F.col("reject_reason").alias("error"),
    )
    return AppendOutcome(receipts, known.unionByName(rejected), fresh.count())


#: Receipts of one file of a batch, as long as that makes no more than so many files.
FILE_RECEIPTS, MOST_FILES = 1 << 13, 10_000


def commit_receipts(
    table: BatchTable, events: DataFrame, batch_id: int, received_at: str, block: int = BLOCK
) -> None:
    """Append one batch. Receipts and bindings are columns of one table, so they commit together;
    a repeated batch id is a no-op and an unfinished one is rewritten."""
    if table.has(batch_id):
        return
    head = table.head()
    # Directories of this batch id may be left from a failed try; they are pruned, not read.
    stored = bindings_of(table.read().where(F.col("batch_id") < int(batch_id)))
    outcome = append_receipts(events, stored, head, received_at, block)
    # The sequences are dense, so a row's file follows from its number, without a sample.
    size = max(FILE_RECEIPTS, -(-outcome.count // MOST_FILES))
    files = max(1, -(-outcome.count // size))
    number = F.expr(f"cast((sequence - {head} - 1) div {size} as int)")
    ordered = outcome.receipts.repartitionById(files, number).sortWithinPartitions("sequence")
    table.write(ordered, batch_id)
    table.commit(batch_id, head + outcome.count)


class CursorError(ValueError):
    """The cursor is malformed, from another store, or ahead of this one."""


@dataclass(frozen=True)
class Cursor:
    """Position of a consumer. ``through`` = 0 means: open a new horizon on the next page."""

    store_id: str
    after: int = 0
    through: int = 0

    def encode(self) -> str:
        document = {
            "store_id": self.store_id, "after": str(self.after), "through": str(self.through)
        }
        raw = json.dumps(document, separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")

    @staticmethod
    def decode(text: str, store_id: str, head: int) -> Cursor:
        """Decode and check a cursor against the store; '' starts at the beginning."""
        if not text:
            return Cursor(store_id, 0, head)
        try:
            if len(text) > 512:
                raise ValueError("too long")
            raw = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            cursor = Cursor(raw["store_id"], int(raw["after"]), int(raw["through"]))
        except (ValueError, KeyError, TypeError) as error:
            raise CursorError("malformed") from error
        if len(cursor.store_id) != 32 or cursor.store_id != store_id:
            raise CursorError("other store")
        if min(cursor.after, cursor.through) < 0 or max(cursor.after, cursor.through) > head:
            raise CursorError("ahead of the store")
        if cursor.through and cursor.after > cursor.through:
            raise CursorError("after its own horizon")
        return Cursor(store_id, cursor.after, cursor.through or head)


def page_rows(
    receipts: DataFrame, after: int, through: int, limit: int = MAX_QUERY_LIMIT,
    max_bytes: int = MAX_PAGE_BYTES,
) -> DataFrame:
    """The receipts of one page: at most ``limit``, at most ``max_bytes``, at least one.

    Sequences are dense, so the candidates are a range of at most ``limit`` rows and the running
    size is taken over those alone.
    """
    if not 1 <= limit <= MAX_QUERY_LIMIT:
        raise CursorError(f"limit must be between 1 and {MAX_QUERY_LIMIT}")
    candidates = receipts.where(
        (F.col("sequence") > after) & (F.col("sequence") <= min(through, after + limit))
    )
    order = Window.orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return (
        candidates.withColumn("_size", F.sum(F.octet_length("body")).over(order))
        .where((F.col("_size") <= max_bytes) | (F.col("sequence") == after + 1))
        .drop("_size")
        .orderBy("sequence")
    )


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    high_water: int
    next_cursor: str
    has_more: bool


def read_page(
    receipts: DataFrame, store_id: str, head: int, cursor: str = "", limit: int = MAX_QUERY_LIMIT
) -> Page:
    """One page under a frozen horizon. The last page's cursor opens a new horizon next time, so
    late producer events are collected by sequence, never by their own time."""
    position = Cursor.decode(cursor, store_id, head)
    rows = page_rows(receipts, position.after, position.through, limit)
    count, last = rows.agg(F.count(F.lit(1)), F.max("sequence")).first()
    expected = position.after + count
    if (count and last != expected) or (not count and position.after < position.through):
        raise LookupError(f"receipt {position.after + count + 1} is missing or not readable")
    has_more = expected < position.through
    following = Cursor(store_id, expected, position.through if has_more else 0)
    return Page(rows, position.through, following.encode(), has_more)


def page_index(
    receipts: DataFrame, after: int, through: int, limit: int = MAX_QUERY_LIMIT,
    max_bytes: int = MAX_PAGE_BYTES, block: int = BLOCK,
) -> DataFrame:
    """All pages a consumer would walk from ``after`` to ``through``, one row each.

    Paging is greedy and so sequential; it restarts at block bounds, where a page may be short.
    """
    sized = receipts.where(
        (F.col("sequence") > after) & (F.col("sequence") <= through)
    ).select("sequence", F.octet_length("body").cast("bigint").alias("bytes"))
    pages = pack_greedy(sized, "sequence", "bytes", max_bytes, limit, block=block)
    return pages.select(
        F.col("ordinal").alias("page_no"),
        "from_sequence", "through_sequence", "record_count",
        F.col("plain_bytes").alias("page_bytes"),
        (F.col("through_sequence") < through).alias("has_more"),
    )


def hot_or_cached(
    bindings: DataFrame, hot: DataFrame, cache: DataFrame, floor: int | Column
) -> DataFrame:
    """Body and state of every receipt.

    ``hot`` when the live body exists; at or below the retirement floor ``cached`` or
    ``archive_unavailable``; a missing body above the floor is ``corrupt``, and so is a body whose
    digest differs from the binding.
    """
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    below = F.col("sequence") <= floor
    joined = (
        bindings.select("sequence", "event_id", "record_sha256")
        .join(hot.select("sequence", F.col("body").alias("_hot")), "sequence", "left")
        .join(cache.select("sequence", F.col("body").alias("_cached")), "sequence", "left")
    )
    body = F.coalesce(F.col("_hot"), F.when(below, F.col("_cached")))
    state = (
        F.when(body.isNull(), F.when(below, "archive_unavailable").otherwise("corrupt"))
        .when(record_digest(body) != F.col("record_sha256"), "corrupt")
        .when(F.col("_hot").isNotNull(), "hot")
        .otherwise("cached")
    )
    return joined.withColumns({"body": body, "state": state}).drop("_hot", "_cached")
