"""Log forwarding and receipt collection as streams.

The stream checkpoint is the cursor: it moves only after a batch is committed, so a failed batch is
sent again and the batch tables make that harmless. A file is read once, in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from tallylog.operators.scan import (
    BLOCK, ORDERED_BLOCK, dense_sequence, ordered_blocks, running,
)
from tallylog.plans.ingest import ingest_events
from tallylog.plans.receipts import commit_receipts
from tallylog.session import checkpointed, released_checkpoints
from tallylog.sources.backlog import backlog_stats
from tallylog.sources.batches import batch_events, check_batches
from tallylog.sources.events import STORED_COLUMNS, label_events
from tallylog.sources.idindex import IdIndex
from tallylog.sources.journal import line_columns, lines_in_order
from tallylog.sources.receipts import RECEIPT_SCHEMA
from tallylog.sources.tables import BatchTable
from tallylog.streaming.backlog import StatusTable

_EVENT_TABLE = ", ".join(f"{name} {kind}" for name, kind in STORED_COLUMNS.items())
_LABELS = "label_key string, last bigint"
_QUARANTINE = "arrival bigint, origin string, reason string, content string"


@dataclass(frozen=True)
class EventSink:
    """Idempotent sink: events unique by id, unusable input in a quarantine table."""

    spark: SparkSession
    path: str
    block: int = BLOCK

    @property
    def events(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/events", _EVENT_TABLE)

    @property
    def labels(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/labels", _LABELS)

    @property
    def index(self) -> IdIndex:
        return IdIndex(self.spark, f"{self.path}/ids")

    @property
    def rejected(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/rejected", _QUARANTINE)

    def _label_state(self, batch_id: int) -> DataFrame:
        """The last index time of every label set before a batch.

        Each batch writes the whole state, which is one row a label set, so one directory is read
        however many batches there were.
        """
        before = self.labels.commits().where(F.col("batch_id") < int(batch_id))
        last = before.agg(F.max("batch_id")).first()[0]
        rows = self.labels.read() if last is not None else self.labels.read().limit(0)
        return rows.where(F.col("batch_id") == F.lit(last)).select("label_key", "last")

    def store(self, events: DataFrame, quarantined: DataFrame, batch_id: int) -> None:
        """Store one batch. Called again for the same batch it does nothing, or finishes it.

        Ids already stored are found by an index of all of them, so there is no bound on how late a
        replay may come. The events commit is the last step.
        """
        if self.events.has(batch_id):
            return
        earlier = self.events.commits().where(F.col("batch_id") < int(batch_id))
        head, batches = earlier.agg(F.coalesce(F.max("head"), F.lit(0)), F.count(F.lit(1))).first()
        # The index reads only what may hold an id of this batch.
        known = self.index.known(events.select("event_id").where("event_id is not null").distinct(), batches)
        outcome = ingest_events(events, checkpointed(known))
        numbered = dense_sequence(outcome.accepted, "arrival", "_n", head, self.block)
        numbered = numbered.withColumn("arrival", F.col("_n")).drop("_n")
        prior = self._label_state(batch_id)
        labelled = label_events(numbered, self.block, prior)
        self.events.write(
            labelled.select(*STORED_COLUMNS, "label_key"), batch_id,
            ("env", "retention_tier", "dt"),
        )
        # The schema is given, since a batch without a new event has no file to infer it from.
        written = self.spark.read.schema(f"{_EVENT_TABLE}, label_key string").parquet(
            f"{self.events.path}/data/batch_id={int(batch_id)}"
        )
        newest = written.select("label_key", F.col("push_nanos").alias("last")).unionByName(prior)
        self.index.write(written.select("event_id"), batches)
        self.labels.write(
            newest.groupBy("label_key").agg(F.max("last").alias("last")), batch_id
        )
        self.labels.commit(batch_id)
        head = written.agg(F.coalesce(F.max("arrival"), F.lit(head))).first()[0]
        refused = outcome.results.where(F.col("status") == "rejected").select(
            "arrival", F.lit("event").alias("origin"), F.col("error").alias("reason"),
            F.col("event_id").alias("content"),
        )
        self.rejected.write(refused.unionByName(quarantined), batch_id)
        self.rejected.commit(batch_id)
        self.events.commit(batch_id, head)
        self.index.tidy(batches + 1)


def line_stream(
    spark: SparkSession, folder: str, files_per_trigger: int = 1000
) -> DataFrame:
    """Text lines of exported log files, to be forwarded in file and line order; the bound is per
    micro-batch, not a total."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
        .load(folder).select(*line_columns())
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Number the rows of a micro-batch anew, uniquely.

    An ``arrival`` of the input is a wish for an order, not a number to trust: two files of one
    batch may both begin at 0. Rows are ordered by file (``path``, if the stream has it), then by
    that arrival, then by event id and by all that is left of a tie.
    """
    order = [c for c in ("path", "arrival") if c in rows.columns]
    if not order:
        return rows.withColumn("arrival", F.monotonically_increasing_id())
    tie = F.xxhash64(*[c for c in rows.columns if c not in order])
    placed = ordered_blocks(rows.withColumn("_tie", tie), [*order, "event_id", "_tie"])
    return placed.withColumn("arrival", F.col("order_no")).drop("order_no", "_tie")


def batch_stream(
    spark: SparkSession, folder: str, files_per_trigger: int = 1000, whole_files: bool = True
) -> DataFrame:
    """Queued batches as (path, body), oldest file first.

    A file is one batch, or, with ``whole_files=False``, has one batch per line: at scale many
    small batches are better kept in few files.
    """
    return (
        spark.readStream.format("text").option("wholetext", str(whole_files).lower())
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    )


@dataclass(frozen=True)
class Tracking:
    """Where a stream writes its status, under which name, and what time it is."""

    table: StatusTable
    stream: str
    now: Callable[[], str]

    def around(self, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def tracked(batch: DataFrame, batch_id: int) -> None:
            try:
                handle(batch, batch_id)
                count = batch.count()
            except Exception as error:
                self.table.failed(self.stream, error)
                raise
            self.table.stored(self.stream, batch_id, count, self.now())

        return tracked


def forward_lines(
    lines: DataFrame, sink: EventSink, checkpoint: str, parse: Callable[[DataFrame], DataFrame],
    tracking: Tracking | None = None,
) -> DataStreamWriter:
    """Parse log lines (``parse_journal`` or ``parse_container`` with its config) into the sink."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Parsed once: storing reads the rows for ids, labels, events and the quarantine.
        with released_checkpoints():
            parsed = checkpointed(parse(lines_in_order(batch)))
            usable = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
            content = F.col("line") if "line" in parsed.columns else F.col("fields")
            bad = parsed.where(F.col("reject_reason").isNotNull()).select(
                "arrival", F.lit("line").alias("origin"), F.col("reject_reason").alias("reason"),
                content.alias("content"),
            )
            sink.store(usable, bad, batch_id)

    step = tracking.around(handle) if tracking else handle
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def forward_batches(
    batches: DataFrame, sink: EventSink, checkpoint: str, tracking: Tracking | None = None
) -> DataStreamWriter:
    """Replay queued batches; unreadable ones are kept whole in the quarantine."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with released_checkpoints():
            # Path order is age order; the dense number of a path orders its events.
            placed = ordered_blocks(batch, ["path"])
            numbered = running(
                placed, "order_no", sums={"batch_no": F.lit(1).cast("bigint")}, block=ORDERED_BLOCK
            )
            checked = checkpointed(check_batches(numbered))
            bad = checked.where(F.col("batch_error").isNotNull()).select(
                F.col("batch_no").alias("arrival"), F.lit("batch").alias("origin"),
                F.col("batch_error").alias("reason"), F.col("body").alias("content"),
            )
            sink.store(batch_events(checked, "batch_no"), bad, batch_id)

    step = tracking.around(handle) if tracking else handle
    return batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def collect_receipts(
    events: DataFrame, table_path: str, checkpoint: str, received_at: Callable[[], str],
    block: int = BLOCK,
) -> DataStreamWriter:
    """Usage events into the receipt table, numbered in commit order.

    There is no watermark: an event of any age is appended, and consumers meet it at its sequence.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        table = BatchTable(batch.sparkSession, table_path, RECEIPT_SCHEMA)
        if table.has(batch_id):
            return
        with released_checkpoints():
            rows = _in_order(batch)
            commit_receipts(table, rows, batch_id, received_at(), max(block, ORDERED_BLOCK))

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is there, then stop; errors are raised here."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def bounded_dedupe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Explicitly bounded alternative to the table join: forget ids older than ``delay``.

    Only for streams whose replays are known to come within the delay.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


@dataclass
class ForwardStatus:
    cursor: str = ""
    last_upload_at: str = ""
    last_error: str = ""
    degraded: bool = False
    last_uploaded_count: int = 0


class StatusListener(StreamingQueryListener):
    """Keeps the forwarding status of the running streams, one small record per stream."""

    def __init__(self):
        self.status: dict[str, ForwardStatus] = {}

    def _of(self, event) -> ForwardStatus:
        return self.status.setdefault(str(event.id), ForwardStatus())

    def onQueryStarted(self, event):
        self._of(event)

    def onQueryProgress(self, event):
        progress = event.progress
        status = self.status.setdefault(str(progress.id), ForwardStatus())
        status.cursor = json.dumps([s.endOffset for s in progress.sources])
        status.last_error, status.degraded = "", False
        status.last_uploaded_count = progress.numInputRows
        if progress.numInputRows:
            status.last_upload_at = progress.timestamp

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            status = self._of(event)
            status.last_error, status.degraded = event.exception, True


def status_rows(listener: StatusListener, backlog: DataFrame, now: str) -> DataFrame:
    """Forwarding status per stream next to the backlog statistics."""
    spark = backlog.sparkSession
    rows = [(k, *vars(v).values()) for k, v in listener.status.items()]
    names = ", ".join(
        ["stream_id string", "cursor string", "last_upload_at string", "last_error string",
         "degraded boolean", "last_uploaded_count bigint"]
    )
    stats = backlog_stats(backlog, now).first()  # one row
    return spark.createDataFrame(rows, names).withColumns(
        {name: F.lit(value) for name, value in stats.asDict().items()}
    )
