"""Durable consumers of the receipt table.

A consumer's position is committed data: the head of the table it delivers into, so rows and cursor
move in one step and a consumer that died halfway delivers nothing twice. ``PageCursors`` keeps the
position of consumers that take pages and keep their rows elsewhere.

The stream reads the receipt table's commits. A micro-batch ends at the largest sequence of its
commits, which is its frozen horizon: receipts that are committed meanwhile, however old their own
time, come with a later one. Sequences are dense, so a horizon is a range, read with pruning and
delivered by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallylog.plans.receipts import Page, hot_or_cached, read_page
from tallylog.schema import MAX_QUERY_LIMIT
from tallylog.session import released_checkpoints
from tallylog.sources.tables import BatchTable

#: Rows (sequence and what a consumer needs) with after < sequence <= through.
ReadRange = Callable[[int, int], DataFrame]


def table_range(table: BatchTable) -> ReadRange:
    """Receipts whose bodies are all live."""

    def read(after: int, through: int) -> DataFrame:
        return table.read().where((F.col("sequence") > after) & (F.col("sequence") <= through))

    return read


def hot_and_cached_range(
    bindings: DataFrame, hot: DataFrame, cache: DataFrame, floor: int
) -> ReadRange:
    """Receipts by their bindings, with live bodies or, up to ``floor``, with cached ones.

    A body that is neither, or does not match its binding, stops the reader: a page is whole or not
    given at all.
    """

    def read(after: int, through: int) -> DataFrame:
        def part(rows: DataFrame) -> DataFrame:
            return rows.where((F.col("sequence") > after) & (F.col("sequence") <= through))

        found = hot_or_cached(part(bindings), part(hot), part(cache), floor)
        broken = F.raise_error(F.concat(
            F.lit("receipt "), F.col("sequence").cast("string"), F.lit(" is "), F.col("state")))
        return found.withColumn(
            "body", F.when(F.col("state").isin("hot", "cached"), F.col("body")).otherwise(broken))

    return read


def whole_range(rows: DataFrame, after: int, through: int) -> DataFrame:
    """The same rows, once it is known that no sequence is missing or twice."""
    count, distinct = rows.agg(F.count("sequence"), F.count_distinct("sequence")).first()
    if count != through - after or distinct != count:
        raise LookupError(
            f"receipts {after + 1} to {through}: {count} rows with {distinct} sequences")
    return rows


@dataclass(frozen=True)
class Consumer:
    """Delivers every receipt once into ``delivered``, whose head is the cursor.

    ``deliver`` makes the rows to store out of a horizon's receipts.
    """

    read: ReadRange
    delivered: BatchTable
    deliver: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def position(self) -> int:
        return self.delivered.head()

    def advance(self, through: int, number: int) -> None:
        """Deliver up to ``through`` as delivery ``number``; a repeated number does nothing."""
        if self.delivered.has(number):
            return
        after = self.position()
        through = max(after, through)
        rows = whole_range(self.read(after, through), after, through)
        self.delivered.write(self.deliver(rows).withColumn("horizon", F.lit(through)), number)
        self.delivered.commit(number, through)


def commit_stream(spark: SparkSession, table: BatchTable, commits_per_trigger: int = 1000) -> DataFrame:
    """The commits of a table, as they come. A folded commit file repeats earlier rows."""
    return (
        spark.readStream.schema("batch_id bigint, head bigint")
        .option("maxFilesPerTrigger", commits_per_trigger).option("ignoreMissingFiles", "true")
        .option("recursiveFileLookup", "true").parquet(f"{table.path}/commits")
    )


def consume(commits: DataFrame, consumer: Consumer, checkpoint: str) -> DataStreamWriter:
    """Deliver each micro-batch's horizon. The stream's checkpoint only says which commits were seen;
    the cursor is the consumer's own table, so a lost checkpoint delivers nothing again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        horizon = batch.agg(F.coalesce(F.max("head"), F.lit(0))).first()[0]
        if horizon <= consumer.position():
            return
        with released_checkpoints():
            # Deliveries are numbered by horizon, so a new checkpoint cannot reuse a number.
            consumer.advance(horizon, horizon)

    return commits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


@dataclass(frozen=True)
class PageCursors:
    """Stored cursors of page readers, one row a consumer; each step writes the small whole."""

    spark: SparkSession
    path: str

    @property
    def table(self) -> BatchTable:
        return BatchTable(self.spark, self.path, "consumer string, cursor string")

    def _rows(self) -> tuple[DataFrame, int]:
        table = self.table
        last = table.commits().agg(F.max("batch_id")).first()[0]
        if last is None:
            return table.read().select("consumer", "cursor"), 0
        return table.read().where(F.col("batch_id") == last).select("consumer", "cursor"), last + 1

    def load(self, consumer: str) -> str:
        """The stored cursor, '' for a consumer that has none yet."""
        row = self._rows()[0].where(F.col("consumer") == consumer).first()
        return row["cursor"] if row else ""

    def save(self, consumer: str, cursor: str) -> None:
        rows, number = self._rows()
        others = rows.where(F.col("consumer") != consumer)
        own = self.spark.createDataFrame([(consumer, cursor)], "consumer string, cursor string")
        self.table.write(others.unionByName(own).coalesce(1), number)
        self.table.commit(number)


def next_page(
    receipts: ReadRange, store_id: str, head: int, cursors: PageCursors, consumer: str,
    limit: int = MAX_QUERY_LIMIT,
) -> Page:
    """The page at a consumer's stored cursor. ``cursors.save`` with its ``next_cursor`` is the
    acknowledgement; without it the same page comes again."""
    return read_page(receipts(0, head), store_id, head, cursors.load(consumer), limit)
