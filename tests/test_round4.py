"""Queries of the fourth round's findings against their SQL, in layouts that larger tables have."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from tallylog.plans import export
from tallylog.functions.canonical import _canonical, canonical_json, has_inexact_number
from tallylog.functions.redact import KEY_NAMES, TEXT_MARKERS, has_marker, may_hold_secret
from tallylog.plans.export import SetIdentity, capture_export, capture_manifest, manifest_violations
from tallylog.plans.receipts import commit_receipts
from tallylog.sources.receipts import receipt_table, scan_receipts
from workload.compare import compare, connect
from workload.stored_queries import usage_receipt_events

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def many_files(spark):
    """Shuffles keep all their partitions, so small tables are written as many files too."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1b")
    yield spark
    spark.conf.set(key, before)


def test_receipts_of_folders_with_many_files(many_files):
    equal, message = compare(many_files, connect(FOLDER), FOLDER, "stream_receipts")
    assert equal, message


def test_a_large_capture_has_no_more_parts_than_a_set_may_have(spark, tmp_path, monkeypatch):
    """Parts of the wanted size would be too many; larger ones hold the same records."""
    table = receipt_table(spark, str(tmp_path / "receipts"))
    sound = usage_receipt_events(spark, FOLDER).where(F.col("event_id").rlike("-(click|purchase)$"))
    commit_receipts(table, sound, 0, "2024-02-01 00:00:00")
    stored, head = scan_receipts(table), table.head()
    identity = SetIdentity(
        "set-1", "prod", "stack", "ab" * 16, "key-1", "2024-02-02 00:00:00", ("prod",), ("ef" * 32,))
    monkeypatch.setattr(export, "MAX_SET_PARTS", 100)
    capture = capture_export(stored, 0, 0, head, ["prod"], part_bytes=2000)
    manifest, parts = capture_manifest(capture, stored, identity, part_bytes=2000)
    assert manifest_violations(manifest, parts).collect() == []
    assert parts.count() <= 100 < head // 2
    assert capture.parts.agg(F.sum("record_count")).first()[0] == head == capture.lines.count()


def test_only_numbers_are_taken_for_inexact_ones(spark):
    """A colon in a time made every text with one a hard one; texts that are not JSON stay NULL."""
    texts = {
        '{"t":"T00:00:00.5Z"}': False, '{"t":"1.5"}': False, '{"a":1,"b":[2,3]}': False, "7": False,
        '{"a" :\t1.5}': True, "[1e5]": True, "[0, -0]": True, "1.5": True, '{"a":1234567890123456789}': True,
    }
    wrong = ['{"t":"T00:00:00.5Z"} x', "{}{}", "x", "[1", ""]
    rows = spark.createDataFrame([(t,) for t in [*texts, *wrong]], "t string").select(
        "t", has_inexact_number(F.col("t")).alias("inexact"), canonical_json(F.col("t")).alias("c")).collect()
    assert {r.t: r.inexact for r in rows if r.t in texts} == texts
    assert {r.t: r.c for r in rows} == {t: _canonical(t) for t in [*texts, *wrong]}


def test_every_marker_is_found(spark):
    names = [f"a {m.upper()}x" for m in TEXT_MARKERS]
    keys = [f'{{"my_{k.replace("_", "-").upper()}":1}}' for k in KEY_NAMES]
    rows = spark.createDataFrame([(t,) for t in [*names, *keys, "plain", None]], "t string").select(
        "t", has_marker(F.col("t")).alias("m"), may_hold_secret(F.col("t")).alias("s")).collect()
    assert all(r.m and r.s for r in rows if r.t in names) and all(r.s for r in rows if r.t in keys)
    assert not any(r.m or r.s for r in rows if r.t in ("plain", None))
