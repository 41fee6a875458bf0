"""The bounded queue and the status table."""

from tallylog.streaming.backlog import BacklogLedger, StatusTable


def test_oldest_files_are_dropped_and_recorded(spark, tmp_path):
    queue = tmp_path / "q"
    queue.mkdir()
    for number in range(6):
        (queue / f"{number}.json").write_text("x" * 100)
    ledger = BacklogLedger(spark, str(queue), str(tmp_path / "ledger"), 250)
    assert ledger.trim() == 4 and sorted(p.name for p in queue.glob("*.json")) == ["4.json", "5.json"]
    assert ledger.trim() == 0
    # A run that died after the record and before the deletion: the file goes without a second record.
    (queue / "2.json").write_text("x" * 100)
    assert ledger.trim() == 0 and not (queue / "2.json").exists()
    (queue / "6.json").write_text("x" * 100)
    assert ledger.trim() == 1
    names = sorted(r.path[-6:] for r in ledger.dropped.read().collect())
    assert names == ["0.json", "1.json", "2.json", "3.json", "4.json"]
    assert BacklogLedger(spark, str(queue), str(tmp_path / "other"), 0).trim() == 0


def test_status_keeps_the_last_upload_through_errors(spark, tmp_path):
    table = StatusTable(spark, str(tmp_path / "s"))
    assert table.read().count() == 0
    table.stored("a", 3, 20, "2026-01-01 00:00:00")
    table.failed("b", ValueError("no\nmore"))
    table.failed("a", ValueError(""))
    rows = {r.stream: r for r in table.read().collect()}
    assert (rows["a"].cursor, rows["a"].last_uploaded_count, rows["a"].degraded) == ("batch 3", 20, True)
    assert rows["a"].last_error == "ValueError" and rows["b"].last_error == "no"
    table.stored("a", 4, 1, "2026-01-01 00:00:05")
    row = table.read().where("stream = 'a'").first()
    assert (row.cursor, row.degraded, row.last_error) == ("batch 4", False, "")
