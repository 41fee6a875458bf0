"""The id index: exact answers, and reads that do not grow with the number of batches."""

import os

import pytest
from pyspark.sql import functions as F

from tallylog.sources.idindex import IdIndex, live_runs
from tallylog.sources.tables import FOLD, BatchTable
from tallylog.streaming.forward import EventSink


def test_runs_are_the_digits_of_the_number_of_batches():
    for batches in range(200):
        covered = [b for level, start in live_runs(batches, 4) for b in range(start, start + 4**level)]
        assert covered == list(range(batches))
        assert len(live_runs(batches, 4)) <= 3 * 4


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "event_id string")


def test_known_ids_over_many_batches(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=4, parts=1, fan=3)
    seen = set()
    assert index.known(ids(spark, "a"), 0).count() == 0
    for batch in range(11):
        asked = {f"e{batch * 5 + i}" for i in range(-7, 5)} | {"never"}
        found = {r[0] for r in index.known(ids(spark, *sorted(asked)), batch).collect()}
        assert found == asked & seen
        fresh = {f"e{batch * 5 + i}" for i in range(5)} if batch != 4 else set()
        rows = ids(spark, *sorted(fresh)) if fresh else ids(spark, "x").limit(0)
        for _ in range(2 if batch == 5 else 1):  # a batch that is written again
            index.write(rows, batch)
        index.tidy(batch + 1)
        seen |= fresh
    kept = {p for p in os.listdir(tmp_path / "ids" / "runs")}
    assert kept == {f"level={level}-start={start}" for level, start in live_runs(11, 3)}
    assert os.listdir(tmp_path / "ids" / "bloom") == ["upto=11"]


def test_a_full_filter_only_costs_reads(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=2, parts=1)
    many = spark.range(60_000).select(F.concat(F.lit("m"), "id").alias("event_id"))
    index.write(many, 0)
    other = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("event_id"))
    assert index.possible(other, 1).count() > 1500
    assert index.known(other.unionByName(many.limit(50)), 1).count() == 50


EVENT = {
    "level": "info", "msg": "m", "service": "s", "env": "e", "version": "v", "host": "h", "unit": "u",
    "source": "j",
}


def test_files_read_by_a_batch_do_not_grow(spark, tmp_path):
    from tallylog.schema import conform_events

    sink = EventSink(spark, str(tmp_path / "store"))

    def events(batch):
        rows = spark.range(batch * 20, batch * 20 + 20).select(
            F.col("id").alias("arrival"), F.concat(F.lit("e"), "id").alias("event_id"),
            F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
            *[F.lit(v).alias(k) for k, v in EVENT.items()])
        return conform_events(rows)

    quarantine = spark.createDataFrame(
        [], "arrival bigint, origin string, reason string, content string")
    looked = []
    real = IdIndex.known

    def known(self, asked, batches):
        found = real(self, asked, batches)
        looked.append(len(found.inputFiles()))
        return found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(IdIndex, "known", known)
        for batch in range(9):
            sink.store(events(batch), quarantine, batch)
        sink.store(events(3), quarantine, 9)  # a late replay
    assert sink.events.read().count() == 180
    # New ids are in no bucket that is read, but for a rare false hit; a replay reads its buckets.
    assert max(looked[:9]) <= 2 and looked[9] <= 2 * 20
    assert len(os.listdir(tmp_path / "store" / "ids" / "bloom")) == 1


def test_commits_are_folded(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "x bigint")
    for batch in range(FOLD + 3):
        table.commit(batch, 10 * batch)
    table.commit(FOLD + 2, 10 * (FOLD + 2))
    assert len(os.listdir(tmp_path / "t" / "commits")) <= FOLD
    assert sorted(r.batch_id for r in table.commits().collect()) == list(range(FOLD + 3))
    assert table.head() == 10 * (FOLD + 2) and table.has(0)
