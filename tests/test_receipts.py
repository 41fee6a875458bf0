"""Usage events, receipts, paging, exports and the lifecycle, against vectors and brute force."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallylog.functions.identity import sealed_status_digest
from tallylog.functions.usage import usage_bindings
from tallylog.operators.dedupe import first_wins, salted_lookup
from tallylog.operators.packing import pack_greedy
from tallylog.operators.ranges import in_ranges
from tallylog.operators.scan import (
    broken_links, covered_prefix, dense_sequence, monotone_times, running, sequence_gaps,
)
from tallylog.plans.export import digest_tree, manifest_violations, read_exports
from tallylog.plans.lifecycle import check_rehydration, evict_cache, rehydrate_cache
from tallylog.plans.receipts import (
    Cursor, CursorError, append_receipts, commit_receipts, page_rows, read_page,
)
from tallylog.schema import conform_events
from tallylog.session import shared_folder
from tallylog.sources.backlog import backlog_over_cap, list_backlog, replay_order
from tallylog.sources.batches import quarantine, read_batches
from tallylog.sources.receipts import receipt_table, scan_receipts

# Published vector: the text and its digest are fixed values.
USAGE = (
    '{"usage_id":"usage-vector","service_code":"mqtt","brand_cloud_id":'
    '"43962cfa-a092-4368-b2c7-32925b0ef54f","event_time":"2026-10-03T01:02:03.123456789Z",'
    '"window_start":"2026-10-03T01:01:03.123456789Z","window_end":"2026-10-03T01:02:03.123456789Z",'
    '"meter_epoch":"epoch-vector","sequence":9007199254740993,"source":"meter","measurements":'
    '[{"metric_code":"publish_bytes","unit":"bytes","quantity":9007199254740993},'
    '{"metric_code":"delivery_bytes","unit":"bytes","quantity":2}]}'
)
USAGE_DIGEST = "467ecdbbe93d2667385d8cd71340b0e7a5884eb143814d6f017fc117632e8cde"


def bindings(spark, texts, sequence=1):
    rows = [(i, sequence, "c" * 64, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, sequence bigint, content_sha256 string, t string")
    return usage_bindings(df, "t").orderBy("i").collect()


def test_usage_vector(spark):
    ours, spaced = bindings(spark, [USAGE, USAGE.replace('"usage-vector"', '" usage-vector "')])
    for row in (ours, spaced):
        assert row.binding_reason is None and row.usage_id == "usage-vector"
        assert row.event_sha256 == USAGE_DIGEST


def test_usage_rejects(spark):
    texts = [
        USAGE + "{}",
        USAGE.replace('"source":', '"unknown":1,"source":'),
        USAGE.replace("9007199254740993", "9007199254740993.0"),
        USAGE.replace("9007199254740993", "9223372036854775808"),
        USAGE.replace('"publish_bytes"', '"unknown_metric"'),
        USAGE.replace('"publish_bytes"', '"delivery_bytes"'),
        USAGE.replace('"window_start":"2026-10-03T01:01:03.123456789Z"',
                      '"window_start":"2026-10-03T01:02:03.123456001Z"'),
        USAGE.replace('"quantity":2', '"quantity":-2'),
        USAGE.replace('"meter"', "5"),
        USAGE.replace('"quantity":2', '"quantity":2,"extra":1'),
        USAGE.replace('"epoch-vector"', '" "'),
    ]
    assert all(r.binding_reason for r in bindings(spark, texts))
    assert bindings(spark, [USAGE], 0)[0].binding_reason == "invalid_record"
    scaled = USAGE.replace('"mqtt"', '"ota"').replace(
        '"publish_bytes","unit":"bytes","quantity":9007199254740993',
        '"successful_download_gib","unit":"GiB","quantity":1,"quantity_scale":9').replace(
        '"delivery_bytes","unit":"bytes"', '"device_task","unit":"tasks"')
    assert bindings(spark, [scaled])[0].binding_reason is None


def test_sealed_decision_vector(spark):
    row = {
        "operation_id": F.lit("operation"), "environment": F.lit("dev"),
        "store_id": F.lit("a" * 32), "from_sequence": F.lit(1), "through_sequence": F.lit(1),
        "plan_sha256": F.lit("d97b684a97aad4e9b1ef6f7ba57e83436bb39e850a10cbac79385db0d1e76ebb"),
        "status": F.lit("completed"),
        "completed_at": F.lit("2026-10-03 01:02:03.123456").cast("timestamp_ntz"),
        "retired_through": F.lit(1), "set_id": F.lit("set"),
    }
    digest = spark.range(1).select(sealed_status_digest(row).alias("d")).first().d
    assert digest == "131cca1d26463c3412d032b12e8041e1e2286aaff53dc7a84498af428e377fe6"


def usage_events(spark, *rows):
    base = ("info", "m", "svc", "prod", "v1", "h", "u", "billing_usage", "billing_usage",
            '{"usage_event":{"quantity":9007199254740993}}')
    names = ("level", "msg", "service", "env", "version", "host", "unit", "source", "stream", "fields")
    full = [
        (i, r["event_id"], r.get("ts", datetime(2026, 1, 1)),
         *[r.get(n, v) for n, v in zip(names, base)]) for i, r in enumerate(rows)]
    schema = "arrival bigint, event_id string, ts timestamp_ntz, " + ", ".join(
        f"{n} string" for n in names)
    return conform_events(spark.createDataFrame(full, schema))


def test_append_duplicates_and_conflicts(spark):
    none = spark.createDataFrame([], "event_id string, content_sha256 string")
    df = usage_events(
        spark, {"event_id": "a"}, {"event_id": "a", "version": "v2", "host": "h2"},
        {"event_id": "a", "env": "other"}, {"event_id": "a", "ts": datetime(2026, 1, 2)},
        {"event_id": "b", "fields": '{"x":1}'}, {"event_id": "c", "msg": "Token"},
        {"event_id": "d", "fields": '{"usage_event":{"token":"t"}}'},
        {"event_id": "e", "fields": '{"usage_event":{"a":"' + "x" * (1 << 20) + '"}}'},
        {"event_id": "f" * 4097},
    )
    out = append_receipts(df, none, 7, "2026-02-01 00:00:00")
    got = [r.status for r in out.results.orderBy("arrival").collect()]
    assert got == ["accepted", "duplicate", "rejected", "rejected", "rejected", "accepted",
                   "rejected", "rejected", "rejected"]
    stored = {r.event_id: r for r in out.receipts.collect()}
    assert {k: r.sequence for k, r in stored.items()} == {"a": 8, "c": 9}
    event = json.loads(stored["c"].body)["event"]
    assert event["msg"] == "[REDACTED]"
    assert "9007199254740993" in stored["a"].body
    again = append_receipts(df.where("event_id='a'"), out.receipts, 9, "2026-02-01 00:00:00")
    assert [r.status for r in again.results.orderBy("arrival").collect()] == [
        "duplicate", "duplicate", "rejected", "rejected"]
    assert again.receipts.count() == 0


def test_commit_is_idempotent_and_paging_freezes_its_horizon(spark):
    table = receipt_table(spark, f"{shared_folder(spark)}/t-{random.random()}")
    first = usage_events(spark, *[{"event_id": f"e{i}"} for i in range(12)])
    commit_receipts(table, first, 0, "2026-02-01 00:00:00", block=5)
    commit_receipts(table, first, 0, "2026-02-01 00:00:00")
    # A try that died before its commit leaves a directory that nobody reads.
    table.write(scan_receipts(table).drop("batch_id"), 1)
    store = "ab" * 16
    page = read_page(scan_receipts(table), store, table.head(), limit=10)
    assert page.rows.count() == 10 and page.has_more and page.high_water == 12
    late = usage_events(spark, {"event_id": "late", "ts": datetime(2025, 1, 1)})
    commit_receipts(table, late, 1, "2026-02-02 00:00:00")
    assert table.head() == 13
    rest = read_page(scan_receipts(table), store, 13, page.next_cursor, 10)
    assert [r.sequence for r in rest.rows.collect()] == [11, 12] and not rest.has_more
    fresh = read_page(scan_receipts(table), store, 13, rest.next_cursor, 10)
    assert [r.event_id for r in fresh.rows.collect()] == ["late"]
    for bad in ("!!", Cursor("cd" * 16).encode(), Cursor(store, 14, 0).encode(),
                Cursor(store, 5, 4).encode(), "a" * 513):
        with pytest.raises(CursorError):
            Cursor.decode(bad, store, 13)
    with pytest.raises(LookupError):
        read_page(scan_receipts(table).where("sequence<>3"), store, 13, "", 10)


def test_page_byte_bound(spark):
    df = spark.range(1, 11).select(
        F.col("id").alias("sequence"), F.repeat(F.lit("x"), 900_000).alias("body"))
    assert page_rows(df, 0, 10, 1000).count() == 9
    assert page_rows(df, 9, 10, 1000).count() == 1
    assert page_rows(df, 0, 10, 1000, max_bytes=10).count() == 1


def test_running_and_monotone_times(spark):
    random.seed(1)
    rows = [(i * 3, random.choice(["a", "a", "a", "b", None]), random.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "n bigint, g string, t bigint")
    last, expected, sums = {}, {}, {}
    for n, g, t in rows:
        last[g] = max(t, last[g] + 1) if g in last else t
        sums[g] = sums.get(g, 0) + t
        expected[n] = (last[g], sums[g])
    p = monotone_times(df, ["g"], "t", "n", "p", block=64)
    p = running(p, "n", ["g"], sums={"s": F.col("t")}, block=50)
    assert {r.n: (r.p, r.s) for r in p.collect()} == expected
    prior = spark.createDataFrame([("a", 1000)], "g string, last bigint")
    assert monotone_times(df, ["g"], "t", "n", "p", 64, prior).where("g='a'").agg(
        F.min("p")).first()[0] == 1001
    numbered = dense_sequence(df, "n", start=10, block=40).orderBy("n").collect()
    assert [r.sequence for r in numbered] == list(range(11, 311))


def test_gaps_and_prefix(spark):
    random.seed(2)
    kept = [i for i in range(1, 100_001) if random.random() > 0.001 and not 40_000 < i < 90_000]
    df = spark.createDataFrame([(i,) for i in kept + kept[:50]], "s bigint").repartition(4)
    gaps, before = [], 0
    for i in [*kept, 100_001]:
        if i > before + 1:
            gaps.append((before + 1, i - 1))
        before = i
    bounds = (F.lit(1).cast("bigint"), F.lit(100_000).cast("bigint"))
    assert sorted(map(tuple, sequence_gaps(df, "s", *bounds).collect())) == gaps
    assert sequence_gaps(df.limit(0), "s", *bounds).collect()[0] == (1, 100_000)
    for seed in range(5):
        random.seed(seed)
        ranges = [(s, s + random.randrange(30)) for s in random.sample(range(1, 200), 25)] + [(1, 3)]
        covered = 0
        for s, e in sorted(ranges):
            if s > covered + 1:
                break
            covered = max(covered, e)
        rows = spark.createDataFrame(ranges, "s bigint, e bigint")
        assert covered_prefix(rows, "s", "e").first().covered == covered


def test_broken_links(spark):
    rows = [("x", 1, 10), ("x", 11, 20), ("x", 22, 30), ("y", 2, 5), ("z", 1, 4), ("z", 5, 5), ("z", 5, 6)]
    df = spark.createDataFrame(rows, "g string, s bigint, e bigint")
    got = {(r.g, r.s, r.copies, r.expected_start) for r in broken_links(df, ["g"], "s", "e", block=4).collect()}
    assert got == {("x", 22, 1, 21), ("y", 2, 1, 1), ("z", 5, 2, 5)}


def test_packing_matches_greedy_and_restarts_per_block(spark):
    random.seed(3)
    sizes = [random.randrange(1, 120) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(sizes, 1)), "s bigint, n bigint")
    parts, used = [[]], 0
    for i, n in enumerate(sizes, 1):
        if parts[-1] and (used + n > 300 or len(parts[-1]) == 7):
            parts.append([])
            used = 0
        parts[-1].append(i)
        used += n
    got = pack_greedy(df, "s", "n", 300, 7).orderBy("ordinal").collect()
    assert [(r.from_sequence, r.through_sequence) for r in got] == [(p[0], p[-1]) for p in parts]
    offset = 0
    for number, r in enumerate(pack_greedy(df, "s", "n", 300, block=128).orderBy("ordinal").collect(), 1):
        assert r.ordinal == number and r.byte_offset == offset and r.plain_bytes <= 300
        assert r.plain_bytes == sum(sizes[r.from_sequence - 1 : r.through_sequence])
        offset += r.plain_bytes
    assert offset == sum(sizes)


def test_backlog_cap_matches_loop(spark):
    random.seed(4)
    files = [(f"q/{random.random():.12f}.json", random.randrange(50)) for _ in range(400)]
    df = spark.createDataFrame(files, "path string, size bigint")
    total, dropped = sum(n for _, n in files), set()
    for path, size in sorted(files):
        if total <= 3000:
            break
        dropped.add(path)
        total -= size
    assert {r.path for r in backlog_over_cap(df, 3000).collect()} == dropped
    assert backlog_over_cap(df, 0).count() == 0


def test_skewed_lookup_and_first_wins(spark):
    df = spark.range(60_000).select(
        F.col("id").alias("arrival"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("event_id"))
    facts = df.groupBy("event_id").agg(F.min("arrival").alias("first"))
    joined = salted_lookup(df, facts, "event_id", "arrival", "inner")
    assert joined.count() == 60_000 and joined.where("event_id='hot' and first<>0").count() == 0
    assert first_wins(df).count() == 20_001


def test_in_ranges(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("n"))
    ranges = spark.createDataFrame([(5, 40), (30, 300), (990, 2000)], "a bigint, b bigint")
    pairs = in_ranges(df, "n", ranges, "a", "b", cell=16)
    assert pairs.count() == 36 + 271 + 11
    assert in_ranges(df, "n", ranges, "a", "b", cell=16, how="left_anti").count() == 1000 - 296 - 11


def test_digest_tree_has_a_fixed_depth(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for count in (0, 1, 3, 37, 60):
        leaves = [digest(str(i)) for i in range(count)]
        level = leaves
        for _ in range(2):
            level = [digest("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
        df = spark.createDataFrame(list(enumerate(leaves)), "n bigint, d string").repartition(3)
        rows = digest_tree(df, "n", "d", fan_out=4, depth=3).collect()
        assert [r.root_sha256 for r in rows] == [digest("".join(level))]
    again = df.unionByName(df.where("n = 5"))
    assert digest_tree(again, "n", "d", fan_out=4, depth=3).first() != rows[0]


def test_manifest_is_valid(spark):
    sha = "a" * 64
    t = datetime(2026, 1, 1)
    manifest = {
        "set_id": "set-1", "version": 1, "environment": "dev", "stack": "s", "store_id": "ab" * 16,
        "encryption_key_id": "k", "source_environments": ["dev"], "created_at": t,
        "max_received_at": t, "from_sequence": 1, "through_sequence": 3, "high_water": 3,
        "record_count": 3, "snapshot_sha256": sha, "bindings_sha256": sha, "snapshot_bytes": 10,
        "recipient_fingerprints": [sha]}
    part = {"set_id": "set-1", "sealed_bytes": 12, "plain_sha256": sha, "sealed_sha256": sha}
    parts = [{**part, "name": "a", "kind": "snapshot", "ordinal": 1, "byte_offset": 0, "plain_bytes": 10},
             {**part, "name": "b", "kind": "events", "ordinal": 1, "byte_offset": 0, "plain_bytes": 5},
             {**part, "name": "c", "kind": "events", "ordinal": 2, "byte_offset": 5, "plain_bytes": 7}]
    frame = lambda rows: spark.createDataFrame(rows)
    assert manifest_violations(frame([manifest]), frame(parts)).count() == 0
    broken = [parts[0], {**parts[1], "byte_offset": 1}, {**parts[2], "ordinal": 4}]
    got = {r.rule for r in manifest_violations(frame([{**manifest, "store_id": "x"}]), frame(broken)).collect()}
    assert got == {"identity", "part_offset", "part_order"}


def test_cache(spark):
    cache = spark.createDataFrame([(1, "a"), (2, "bb"), (9, "c")], "sequence bigint, body string")
    evicted, kept = evict_cache(cache, 5, 1)
    assert [r.sequence for r in evicted.collect()] == [1] and kept.count() == 2
    import hashlib

    t = datetime(2026, 1, 1)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    bound = spark.createDataFrame(
        [(i, "c", sha(f"r{i}"), t, False) for i in range(1, 6)],
        "sequence bigint, content_sha256 string, record_sha256 string, received_at timestamp_ntz, is_legacy boolean")
    sets = spark.createDataFrame([("s", "verified", 1, 5)], "set_id string, status string, from_sequence bigint, through_sequence bigint")
    exports = spark.createDataFrame(
        [("s", i, "c", t, f"r{i}") for i in (1, 2, 3)],
        "set_id string, sequence bigint, content_sha256 string, received_at timestamp_ntz, record string")
    checked = check_rehydration(exports, sets, bound, 4)
    assert checked.where("reason is not null").count() == 0
    assert rehydrate_cache(checked, cache, 100).count() == 4
    with pytest.raises(ValueError):
        rehydrate_cache(checked, cache, 3)
    with pytest.raises(ValueError):
        rehydrate_cache(check_rehydration(exports, sets, bound, 2), cache, 100)


def test_export_decode(spark, tmp_path):
    good = '{"sequence":"1","content_sha256":"c","received_at":"2026-01-01T00:00:00Z","record":{"q":1.50, "a":2}}'
    lines = [good, good + "{}", good.replace('"1"', "1"), good.replace('"1"', '"0"'),
             good.replace('"record"', '"other"'), good.replace("2026-01-01T", "x"), "z" * (2 << 20) + "z"]
    (tmp_path / "part.ndjson").write_text("\n".join(lines))
    rows = read_exports(spark, str(tmp_path)).collect()
    assert [r.decode_error for r in rows] == [
        None, "not one JSON object", "wrong type", "bad sequence", "unknown member", "bad time", "too long"]
    assert rows[0].record == '{"q":1.50, "a":2}'


def test_queue_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"events":[]}')
    (tmp_path / "a.json").write_text("not json")
    listed = replay_order(list_backlog(spark, str(tmp_path))).collect()
    assert [(r.path[-6:], r.size) for r in listed] == [("a.json", 8), ("b.json", 13)]
    good, bad = quarantine(read_batches(spark, str(tmp_path)))
    assert [r.path[-6:] for r in good.collect()] == ["b.json"]
    assert [r.path[-6:] for r in bad.collect()] == ["a.json"]
