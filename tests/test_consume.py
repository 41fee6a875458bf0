"""Durable consumers and online compaction: restarts, damage and races."""

import pytest
from pyspark.sql import functions as F

from tallylog.plans.changes import (
    CompactionError, apply_change_log, compact_online, current_snapshot, publish_snapshot,
    snapshot_table,
)
from tallylog.plans.receipts import CursorError
from tallylog.sources.tables import BatchTable
from tallylog.streaming.consume import (
    Consumer, PageCursors, commit_stream, consume, hot_and_cached_range, next_page, table_range,
)
from tallylog.streaming.forward import drain

RECEIPTS = "sequence bigint, event_id string, record_sha256 string, body string"
STORE = "cd" * 16


def receipts(spark, low, high):
    return spark.range(low, high + 1).select(
        F.col("id").alias("sequence"), F.concat(F.lit("e"), "id").alias("event_id"),
        F.sha2(F.concat(F.lit("b"), "id"), 256).alias("record_sha256"),
        F.concat(F.lit("b"), "id").alias("body"))


def append(table, number, low, high):
    table.write(receipts(table.spark, low, high), number)
    table.commit(number, high)


def delivered_rows(consumer):
    return sorted((r.sequence, r.horizon) for r in consumer.delivered.read().collect())


def test_each_receipt_is_delivered_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), RECEIPTS)
    kept = BatchTable(spark, str(tmp_path / "d"), RECEIPTS + ", horizon bigint")
    consumer = Consumer(table_range(table), kept)
    run = lambda cp: drain(consume(commit_stream(spark, table), consumer, str(tmp_path / cp)))
    append(table, 0, 1, 5)
    run("cp")
    append(table, 1, 6, 7)
    table.commit(2, 7)  # a batch without receipts
    run("cp")
    run("other")  # a lost checkpoint reads all commits again
    assert delivered_rows(consumer) == [(i, 5 if i <= 5 else 7) for i in range(1, 8)]
    consumer.advance(7, 7)
    consumer.advance(3, 99)
    assert len(delivered_rows(consumer)) == 7 and consumer.position() == 7


def test_a_missing_receipt_stops_the_consumer(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), RECEIPTS)
    consumer = Consumer(table_range(table), BatchTable(spark, str(tmp_path / "d"), RECEIPTS + ", horizon bigint"))
    table.write(receipts(spark, 1, 5).where("sequence <> 3"), 0)
    table.commit(0, 5)
    with pytest.raises(LookupError, match="4 rows"):
        consumer.advance(5, 5)
    assert consumer.position() == 0 and delivered_rows(consumer) == []


def test_pages_over_live_and_cached_bodies(spark, tmp_path):
    every = receipts(spark, 1, 9)
    hot, cache = every.where("sequence > 4"), every.where("sequence <= 4")
    cursors = PageCursors(spark, str(tmp_path / "c"))
    assert cursors.load("a") == ""
    read = hot_and_cached_range(every, hot, cache, 4)
    page = next_page(read, STORE, 9, cursors, "a", 6)
    assert [(r.sequence, r.state) for r in page.rows.collect()] == [
        (i, "cached" if i <= 4 else "hot") for i in range(1, 7)]
    again = next_page(read, STORE, 9, cursors, "a", 6)  # not acknowledged
    assert [r.sequence for r in again.rows.collect()] == list(range(1, 7))
    cursors.save("a", page.next_cursor)
    cursors.save("b", "x")
    assert [r.sequence for r in next_page(read, STORE, 9, cursors, "a", 6).rows.collect()] == [7, 8, 9]
    assert cursors.load("b") == "x"
    with pytest.raises(CursorError, match="other store"):
        next_page(read, "ef" * 16, 9, cursors, "a")
    damaged = cache.withColumn("body", F.when(F.col("sequence") == 2, "changed").otherwise(F.col("body")))
    with pytest.raises(Exception, match="receipt 2 is corrupt"):
        next_page(hot_and_cached_range(every, hot, damaged, 4), STORE, 9, PageCursors(
            spark, str(tmp_path / "new")), "a").rows.collect()


def writes(spark, low, high):
    return spark.range(low, high + 1).select(
        F.col("id").alias("generation"), F.lit(0).alias("idx"), F.lit("ids").alias("bucket"),
        F.concat(F.lit("k"), F.col("id") % 7).alias("key"),
        F.when(F.col("id") % 5 == 0, "delete").otherwise("put").alias("kind"),
        F.concat(F.lit("v"), "id").alias("value"), F.lit(None).cast("bigint").alias("sequence"))


class Log:
    """A log that grows by so many generations between the rounds."""

    def __init__(self, spark, first, *growth):
        self.spark, self.end, self.growth = spark, first, list(growth)

    def read(self, after):
        return writes(self.spark, after + 1, self.end)

    def grow(self, number):
        self.end += self.growth.pop(0) if self.growth else 0


def compacted(spark, path, log, **limits):
    table = snapshot_table(spark, str(path))
    if not table.has(0):
        base = spark.createDataFrame([("ids", "k1", "old"), ("ids", "other", "kept")], "bucket string, key string, value string")
        publish_snapshot(table, base, 0)
    compact_online(table, log.read, log.grow, max_seconds=600, **limits)
    return table


def as_map(rows):
    return {(r.bucket, r.key): r.value for r in rows.collect()}


def test_compaction_catches_up(spark, tmp_path):
    log = Log(spark, 100, 60, 40, 12, 9)
    table = compacted(spark, tmp_path / "s", log)
    rows, reached = current_snapshot(table)
    assert reached == 212  # 12 are few enough to be the last round, and 9 never came
    base = table.read().where("batch_id = 0").drop("batch_id")
    assert as_map(rows) == as_map(apply_change_log(base, writes(spark, 1, 212)))
    log.end, log.growth = 300, []
    rows, reached = current_snapshot(compacted(spark, tmp_path / "s", log))
    assert reached == 300
    assert as_map(rows) == as_map(apply_change_log(base, writes(spark, 1, 300)))


def test_compaction_is_given_up(spark, tmp_path):
    table = compacted(spark, tmp_path / "s", Log(spark, 10))
    before = current_snapshot(table)[1]
    with pytest.raises(CompactionError, match="behind after 2 rounds"):
        compacted(spark, tmp_path / "s", Log(spark, 100, *[50] * 9), max_rounds=2)

    class Gap(Log):
        def read(self, after):
            return super().read(after).where("generation <> 30")

    with pytest.raises(CompactionError, match="broken"):
        compacted(spark, tmp_path / "s", Gap(spark, 40))
    with pytest.raises(CompactionError, match="audit"):
        compacted(spark, tmp_path / "s", Log(spark, 40), audit=lambda rows: rows.limit(1))
    assert current_snapshot(table)[1] == before == 10
