"""Streams: restart from a checkpoint, quarantine, late usage events, status."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallylog.session import shared_folder
from tallylog.sources.batches import check_batches, read_batches
from tallylog.sources.journal import JournalConfig, parse_journal, read_lines
from tallylog.sources.receipts import receipt_table, scan_receipts
from tallylog.streaming.forward import (
    EventSink, StatusListener, batch_stream, bounded_dedupe, collect_receipts, drain,
    forward_batches, forward_lines, line_stream, status_rows,
)


def line(cursor, **extra):
    return json.dumps(
        {"__CURSOR": cursor, "_BOOT_ID": "b", "_HOSTNAME": "h", "_SYSTEMD_UNIT": "u",
         "MESSAGE": "m", "__REALTIME_TIMESTAMP": "1780297323000000", **extra})


def test_forwarding_restarts_and_quarantines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    sink = EventSink(spark, str(tmp_path / "store"), block=4)
    parse = lambda df: parse_journal(df, JournalConfig(env="e"))
    run = lambda: drain(
        forward_lines(line_stream(spark, str(source), 1), sink, str(tmp_path / "cp"), parse))

    (source / "1.json").write_text("\n".join([line("a"), line("b"), "broken", line("a")]))
    run()
    (source / "2.json").write_text("\n".join([line("b"), line("c")]))
    run()
    (source / "3.json").write_text("\n".join([line("a"), line("c")]))  # nothing new
    run()
    rows = sink.events.read().orderBy("arrival").collect()
    assert [r.arrival for r in rows] == [1, 2, 3] and len({r.event_id for r in rows}) == 3
    nanos = [r.push_nanos for r in rows]
    assert nanos == sorted(set(nanos)), "index times rise across batches"
    assert [r.content for r in sink.rejected.read().collect()] == ["broken"]
    sink.store(sink.events.read().limit(0), sink.rejected.read().drop("batch_id"), 0)
    assert sink.events.read().count() == 3


def test_lines_keep_file_order_and_checkpoints_go(spark, tmp_path):
    """Three files of rising size in one micro-batch; the scan would pack the largest first."""
    source = tmp_path / "in"
    source.mkdir()
    expected = []
    for number, count in ((1, 2), (2, 40), (3, 800)):
        names = [f"{number}-{i}" for i in range(count)]
        expected += names
        (source / f"{number}.json").write_text("\n".join(line(n, MESSAGE=n) for n in names))
    rows = read_lines(spark, str(source)).orderBy("arrival").collect()
    assert [json.loads(r.line)["MESSAGE"] for r in rows] == expected

    shared_folder(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    sink = EventSink(spark, str(tmp_path / "store"))
    drain(forward_lines(line_stream(spark, str(source)), sink, str(tmp_path / "cp"), parse_journal))
    rows = sink.events.read().orderBy("arrival").collect()
    assert [r.msg for r in rows] == expected
    assert [r.arrival for r in rows] == list(range(1, len(expected) + 1))
    assert set(os.listdir(folder)) <= before, "no checkpoint is left after the commit"


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_oversized_batch_files_are_not_read(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"events":[]}')
    (tmp_path / "2.json").write_text(" " * 5000)
    rows = check_batches(read_batches(spark, str(tmp_path), max_bytes=100)).collect()
    found = {r.path[-6:]: (r.body is None, r.batch_error) for r in rows}
    assert found == {"1.json": (False, None), "2.json": (True, "request body too large")}


def test_queue_replay(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    event = {"event_id": "x", "ts": "2026-01-01T00:00:00Z", "level": "info", "msg": "m",
             "service": "s", "env": "e", "version": "v", "host": "h", "unit": "u", "source": "j"}
    (source / "2.json").write_text(json.dumps({"events": [{**event, "msg": "second"}]}))
    (source / "1.json").write_text(json.dumps({"events": [{**event, "msg": "first"}, {}]}))
    (source / "3.json").write_text("not json")
    sink = EventSink(spark, str(tmp_path / "store"))
    drain(forward_batches(batch_stream(spark, str(source)), sink, str(tmp_path / "cp")))
    assert [r.msg for r in sink.events.read().collect()] == ["first"]
    reasons = {r.reason for r in sink.rejected.read().collect()}
    assert reasons == {"invalid json", "event_id is required"}


def test_late_usage_events_are_collected(spark, tmp_path):
    schema = ("arrival bigint, event_id string, ts timestamp_ntz, level string, msg string, service string, "
              "env string, version string, host string, unit string, source string, stream string, fields string")

    def write(name, *rows):
        full = [(i, e, t, "info", "m", "s", "p", "v", "h", "u", "billing_usage", "billing_usage",
                 '{"usage_event":{"q":1}}') for i, (e, t) in enumerate(rows)]
        from tallylog.schema import conform_events

        conform_events(spark.createDataFrame(full, schema)).coalesce(1).write.parquet(
            str(tmp_path / "in" / name))

    write("a", ("e1", datetime(2026, 1, 2)), ("e2", datetime(2026, 1, 3)))
    kind = spark.read.parquet(str(tmp_path / "in" / "a")).schema
    run = lambda: drain(collect_receipts(
        spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "t"),
        str(tmp_path / "cp"), lambda: "2026-02-01 00:00:00"))
    run()
    write("b", ("e1", datetime(2026, 1, 2)), ("late", datetime(2025, 1, 1)))
    run()
    rows = scan_receipts(receipt_table(spark, str(tmp_path / "t"))).orderBy("sequence").collect()
    assert [(r.sequence, r.event_id) for r in rows] == [(1, "e1"), (2, "e2"), (3, "late")]


def test_status_and_bounded_dedupe(spark, tmp_path):
    listener = StatusListener()
    spark.streams.addListener(listener)
    try:
        spark.range(20).select(
            (F.col("id") % 5).cast("string").alias("event_id"),
            F.lit("2026-01-01 00:00:00").cast("timestamp").alias("ts"),
        ).write.parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        stream = bounded_dedupe(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
            .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        import time

        time.sleep(2)
        spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    backlog = spark.createDataFrame(
        [("q/1.json", 5, datetime(2026, 1, 1))], "path string, size bigint, modified timestamp_ntz")
    row = status_rows(listener, backlog, "2026-01-01 00:02:00").first()
    assert row.degraded is False and row.last_error == ""
    assert (row.file_count, row.total_bytes, row.oldest_age_seconds) == (1, 5, 120)
