"""The stored event table: label-partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tallylog.functions.labels import label_key, retention_policy, retention_tier
from tallylog.functions.redact import redact_event
from tallylog.functions.times import epoch_micros
from tallylog.operators.query import EventQuery, query_events
from tallylog.operators.scan import BLOCK, monotone_times
from tallylog.schema import EVENT_COLUMNS
from tallylog.session import checkpointed

#: Few values each; retention tiers are dropped as whole directories. Never partition on device,
#: user, organisation, request or operation ids, paths or addresses.
PARTITIONS = ("env", "retention_tier", "dt")

STORED_COLUMNS = {
    **EVENT_COLUMNS, "retention_tier": "string", "retention_policy": "string",
    "push_nanos": "bigint", "dt": "date",
}


def label_events(
    events: DataFrame, block: int = BLOCK, prior: DataFrame | None = None
) -> DataFrame:
    """Add the retention labels, the index time ``push_nanos`` and the day ``dt``.

    The index time rises strictly per label set in arrival order; the event keeps its own time.
    ``prior`` (label_key, last) carries the index times of earlier batches.
    """
    tier = retention_tier(F.col("source"), F.col("fields"))
    nanos = F.try_add(
        F.try_multiply(epoch_micros(F.col("ts")), F.lit(1000)), F.coalesce("ts_sub", F.lit(0))
    )
    df = events.withColumn("retention_tier", tier).withColumns(
        {
            "retention_policy": retention_policy(F.col("retention_tier")),
            "label_key": label_key(F.col("retention_tier")),
            "_nanos": nanos.cast("bigint"),
            "dt": F.to_date("ts"),
        }
    )
    return monotone_times(
        df, ["label_key"], "_nanos", "arrival", "push_nanos", block, prior
    ).drop("_nanos")


def write_events(events: DataFrame, path: str, mode: str = "append", block: int = BLOCK) -> None:
    """Append validated events; rows of one partition are written by several tasks, time-sorted.

    An append goes on where the table ends: ``arrival`` is moved behind the largest stored one, and
    index times continue those of their label set, so both stay unique and rising over any number
    of appends. Only the label columns of the stored rows are read for that. One writer at a time;
    use ``EventSink`` where a failed write must be repeatable.

    Partition values are few, so a hash on them alone would leave most tasks idle and one hot;
    an hour is added to spread a day, and adaptive execution splits what is still too large.
    """
    prior = None
    if mode == "append" and (stored := _stored(events.sparkSession, path)) is not None:
        head = stored.agg(F.max("arrival")).first()[0]
        if head is not None:
            events = events.withColumn("arrival", F.col("arrival") + F.lit(head + 1))
            prior = checkpointed(
                stored.withColumn("label_key", label_key(F.col("retention_tier")))
                .groupBy("label_key").agg(F.max("push_nanos").alias("last"))
            )
    labelled = label_events(events, block, prior)
    (
        labelled.withColumn("_hour", F.hour("ts"))
        .hint("rebalance", "env", "retention_tier", "dt", "_hour")
        .sortWithinPartitions(*PARTITIONS, "ts")
        .select(*STORED_COLUMNS)
        .write.mode(mode)
        .partitionBy(*PARTITIONS)
        .option("compression", "zstd")
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The events under a path, or None where there is nothing yet."""
    try:
        return read_events(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_events(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in STORED_COLUMNS.items())
    return spark.read.schema(schema).parquet(path)


def scan_events(
    spark: SparkSession, path: str, query: EventQuery, redacted: bool = True, unique: bool = False
) -> DataFrame:
    """Query the stored table. Bounds on ``ts`` are repeated on the partition column ``dt``.

    ``redacted=False`` redacts again for tables that were not written by this library;
    ``unique=True`` skips the read-time de-duplication for tables the ingest job wrote.
    """
    events = read_events(spark, path)
    for name in ("since", "until"):
        bound = query._instant(name)
        if bound:
            day = F.lit(bound.micros[:10]).cast("date")
            events = events.where(F.col("dt") >= day if name == "since" else F.col("dt") <= day)
    if not redacted:
        events = redact_event(events)
    return query_events(events, query, dedupe=not unique)
