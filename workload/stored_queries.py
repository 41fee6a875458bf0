"""Queries that write a table or run a stream first and then read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.operators.packing import pack_greedy
from tallylog.operators.ranges import in_ranges
from tallylog.operators.scan import ORDERED_BLOCK, ordered_blocks, running
from tallylog.operators.query import EventQuery
from tallylog.plans.audit import FingerprintLog, StoreState, audit_snapshot
from tallylog.plans.changes import (
    compact_online, compact_table, current_snapshot, publish_snapshot, read_change_log, snapshot_table,
)
from tallylog.plans.export import (
    SetIdentity, audit_exports, capture_export, capture_manifest, export_line, manifest_violations,
    read_exports, write_exports,
)
from tallylog.plans.ingest import ingest_events
from tallylog.plans.lifecycle import promote_catalog
from tallylog.plans.receipts import commit_receipts
from tallylog.schema import USAGE_MARKER, conform_events
from tallylog.session import checkpointed, shared_folder
from tallylog.sources.backlog import list_backlog
from tallylog.sources.events import read_events, scan_events, write_events
from tallylog.sources.journal import JournalConfig, parse_journal
from tallylog.sources.receipts import receipt_table, scan_receipts
from tallylog.sources.tables import BatchTable
from tallylog.streaming.consume import (
    Consumer, PageCursors, commit_stream, consume, hot_and_cached_range, next_page, table_range,
)
from tallylog.streaming.backlog import BacklogLedger, StatusTable
from tallylog.streaming.forward import (
    EventSink, Tracking, batch_stream, collect_receipts, drain, forward_batches, forward_lines, line_stream,
)
from workload.event_queries import _EVENT_OUT, _event_sql, ingest_bodies, journal_lines, log_events

from workload.receipt_queries import _RECEIPT_CTE, head_of, receipts, split_store
from workload.registry import query
from workload.tables import derived


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/runs/{name}-{uuid.uuid4().hex}"


@query(
    "event_store_scan",
    _event_sql("level='warn' and ts>=timestamp '2024-01-05 00:00:00' and ts<=timestamp '2024-01-25 00:00:00'",
               "desc", 1000),
    ("log_events",),
)
def event_store_scan(spark, folder):
    """Ingest, write under the label partitions, then query with pruning."""
    path = fresh_folder(spark, "events")
    write_events(ingest_events(log_events(spark, folder)).accepted, path)
    q = EventQuery(
        level="warn", since="2024-01-05T00:00:00Z", until="2024-01-25T00:00:00Z", limit=1000
    )
    return scan_events(spark, path, q, unique=True).select(*_EVENT_OUT)


@query(
    "event_store_append",
    """select event_id, 2 as copies, 2 as arrivals, 2 as push_times from log_events where trim(msg)<>'' and source<>'billing_usage'""",
    ("log_events",),
)
def event_store_append(spark, folder):
    """The same events appended twice: each copy has an arrival and an index time of its own."""
    path = fresh_folder(spark, "appended")
    accepted = checkpointed(ingest_events(log_events(spark, folder)).accepted)
    write_events(accepted, path)
    write_events(accepted, path)
    counts = read_events(spark, path).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("arrival").alias("arrivals"),
        F.count_distinct("push_nanos").alias("push_times"),
    )
    return counts.select(
        "event_id", *[F.col(c).cast("int") for c in ("copies", "arrivals", "push_times")])


@query(
    "event_store_unique",
    _event_sql("level='error'", "asc", 1000),
    ("log_events",),
)
def event_store_unique(spark, folder):
    """A table with every event twice, scanned with de-duplication."""
    path = fresh_folder(spark, "twice")
    accepted = checkpointed(ingest_events(log_events(spark, folder)).accepted)
    write_events(accepted, path)
    write_events(accepted, path)
    found = scan_events(spark, path, EventQuery(level="error", order="asc", limit=1000))
    return found.select(*_EVENT_OUT)


@query(
    "export_roundtrip",
    """select sequence, content_sha256, received_at, '{"k":"'||split_part(body,':',1)||'"}' as record from receipts""",
    ("receipts",),
)
def export_roundtrip(spark, folder):
    """Export lines packed into parts, written as NDJSON and strictly read back."""
    rows = receipts(spark, folder).withColumn(
        "body", F.concat(F.lit('{"k":"'), F.substring_index("body", ":", 1), F.lit('"}'))
    )
    lines = rows.select("sequence", export_line().alias("line"))
    sized = lines.withColumn("bytes", F.octet_length("line") + 1)
    parts = pack_greedy(sized, "sequence", "bytes", 1 << 18)
    placed = in_ranges(
        lines, "sequence",
        parts.select("from_sequence", "through_sequence", F.col("ordinal").alias("part")),
        "from_sequence", "through_sequence", cell=1 << 10,
    )
    path = fresh_folder(spark, "exports")
    write_exports(placed.select("sequence", "line", "part"), path)
    back = read_exports(spark, path)
    return back.where(F.col("decode_error").isNull()).drop("decode_error")


def usage_receipt_events(spark: SparkSession, folder: str) -> DataFrame:
    """Usage texts as receipt input."""
    kind = F.when(F.col("event_type") == "click", 0)
    for number, name in enumerate(("error", "purchase", "signup", "view"), 1):
        kind = kind.when(F.col("event_type") == name, number)
    rows = derived(spark, folder, "usage_text").withColumns(
        {
            "arrival": (F.col("user_id") * 100_000 + F.unix_date("window_day")) * 10 + kind,
            "event_id": F.concat_ws("-", F.lit("u"), "user_id", "window_day", "event_type"),
            "ts": F.col("window_day").cast("timestamp_ntz"),
            "fields": F.concat(F.lit('{"usage_event":'), "usage_json", F.lit("}")),
            **{name: F.lit(value) for name, value in (
                ("level", "info"), ("msg", "usage"), ("service", "meter"), ("env", "prod"),
                ("version", "v1"), ("host", "h1"), ("unit", "u1"),
                ("source", USAGE_MARKER), ("stream", USAGE_MARKER),
            )},
        }
    )
    return conform_events(rows)


@query(
    "capture_totals",
    """select count(*) as record_count, timestamp '2024-02-01 00:00:00' as max_received_at, count(*) as high_water,
 count(*) filter (where event_type in ('error','signup','view')) as rejected, true as contiguous_parts from usage_text""",
    ("usage_text",),
)
def capture_totals(spark, folder):
    """Commit real receipts, capture them, and total the capture and its parts."""
    table = receipt_table(spark, fresh_folder(spark, "receipts"))
    commit_receipts(table, usage_receipt_events(spark, folder), 0, "2024-02-01 00:00:00")
    head = table.head()
    capture = capture_export(scan_receipts(table), 0, 0, head, ["prod"], part_bytes=1 << 20)
    covered = capture.parts.agg(
        (F.sum("record_count") == F.max("through_sequence")).alias("contiguous_parts")
    ).scalar()
    return capture.totals.withColumn("contiguous_parts", covered)


@query(
    "compacted_table",
    """with last as (select bucket, key, arg_max(value, generation) as value, arg_max(kind, generation) as kind from change_log group by 1,2)
select bucket, key, value from last where kind='put'
union all select bucket, key, value from snapshot where key not in (select key from last)""",
    ("change_log", "snapshot"),
)
def compacted_table(spark, folder):
    log = derived(spark, folder, "change_log").withColumns(
        {"idx": F.lit(0), "sequence": F.lit(None).cast("bigint")}
    )
    path = fresh_folder(spark, "compacted")
    compact_table(derived(spark, folder, "snapshot"), log, path)
    return spark.read.schema("bucket string, key string, value string").parquet(path)


@query(
    "stream_journal",
    """select sha256('host-'||(user_id%7)||chr(0)||'boot-1'||chr(0)||event_type||'.service'||chr(0)||'s='||event_id) as event_id, ts,
 case when event_type='click' then 'handled' else event_type||' done' end as msg, 'req-'||event_id as request_id
from events where event_type<>'signup'""",
)
def stream_journal(spark, folder):
    """Journal files forwarded twice by a stream; broken lines go to the quarantine."""
    path = fresh_folder(spark, "journal")
    lines = journal_lines(spark, folder).select(F.col("line").alias("value"))
    lines.write.text(f"{path}/in/a")
    lines.write.text(f"{path}/in/b")
    sink = EventSink(spark, f"{path}/store")
    config = JournalConfig(env="staging")
    source = line_stream(spark, f"{path}/in/*")
    drain(forward_lines(source, sink, f"{path}/checkpoint", lambda df: parse_journal(df, config)))
    return sink.events.read().select("event_id", "ts", "msg", "request_id")


@query(
    "stream_batches",
    """select 'e-'||event_id as event_id, ts, event_type as msg from events where (event_id//10)%10 not in (3,5,8)""",
)
def stream_batches(spark, folder):
    """Queued batch files replayed by a stream."""
    path = fresh_folder(spark, "queue")
    bodies = ingest_bodies(spark, folder)
    bodies.select(F.col("body").alias("value")).write.text(f"{path}/in")
    sink = EventSink(spark, f"{path}/store")
    source = batch_stream(spark, f"{path}/in", whole_files=False)
    drain(forward_batches(source, sink, f"{path}/checkpoint"))
    return sink.events.read().select("event_id", "ts", "msg")


@query(
    "stream_receipts",
    f"""{_RECEIPT_CTE.replace("where event_type='signup' and copy=0", "where false")}
select sequence, event_id from fresh""",
    ("receipt_events",),
)
def stream_receipts(spark, folder):
    """Usage events collected by a stream from two folders that both begin at arrival 0."""
    path = fresh_folder(spark, "usage")
    events = checkpointed(conform_events(derived(spark, folder, "receipt_events")))
    middle = events.agg(F.floor(F.avg("arrival")) + 1).scalar()
    first = events.where(F.col("arrival") < middle)
    second = events.where(F.col("arrival") >= middle).withColumn("arrival", F.col("arrival") - middle)
    # A stream takes files by name, so a folder of many files has to be cut along its arrivals.
    for part, name in ((first, "a"), (second, "b")):
        ranged = part.repartitionByRange("arrival").sortWithinPartitions("arrival")
        ranged.write.parquet(f"{path}/in/{name}")
    schema = spark.read.parquet(f"{path}/in/a").schema
    source = spark.readStream.schema(schema).parquet(f"{path}/in/*").select(
        "*", F.col("_metadata.file_path").alias("path"))
    drain(
        collect_receipts(
            source, f"{path}/table", f"{path}/checkpoint", lambda: "2024-02-01 00:00:00"
        )
    )
    return scan_receipts(receipt_table(spark, f"{path}/table")).select("sequence", "event_id")


class Stopped(Exception):
    """Stands for a consumer that dies."""


@query(
    "cursor_walk",
    """with n as (select max(sequence) as head from receipts)
select sequence, event_id, case when sequence <= head // 3 then head // 3 when sequence <= 2 * (head // 3) then 2 * (head // 3) else head end as horizon, 1 as times
from receipts, n""",
    ("receipts",),
)
def cursor_walk(spark, folder):
    """A consumer that dies in its second horizon, resumes from its stored cursor, and meets the
    receipts that were committed meanwhile, older ones by their own time, in a later horizon."""
    path = fresh_folder(spark, "cursor")
    rows = receipts(spark, folder).withColumn("is_legacy", F.lit(False))
    table = receipt_table(spark, f"{path}/receipts")
    head = head_of(spark, folder)
    bounds = [0, head // 3, 2 * (head // 3), head]
    columns = [c.split()[0] for c in table.schema.split(", ")]

    def add(number: int) -> None:
        low, high = bounds[number], bounds[number + 1]
        part = rows.where((F.col("sequence") > low) & (F.col("sequence") <= high))
        table.write(part.select(*columns), number)
        table.commit(number, high)

    delivered = BatchTable(spark, f"{path}/delivered", "sequence bigint, event_id string, horizon bigint")
    seen = []

    def narrow(part):
        seen.append(part)
        if len(seen) == 2:
            raise Stopped("after the second horizon was read")
        return part.select("sequence", "event_id")

    consumer = Consumer(table_range(table), delivered, narrow)

    def run() -> None:
        # One commit a micro-batch, so each is a horizon of its own.
        drain(consume(commit_stream(spark, table, 1), consumer, f"{path}/checkpoint"))

    add(0)
    add(1)
    try:
        run()
    except Exception as error:  # the stream wraps what its handler raised
        if "Stopped" not in str(error) or consumer.position() != bounds[1]:
            raise
    add(2)
    run()
    counts = delivered.read().groupBy("sequence", "event_id", "horizon").agg(
        F.count(F.lit(1)).cast("int").alias("times"))
    return counts


@query(
    "cursor_pages",
    """select sequence, event_id, octet_length(encode(body)) as bytes, case when sequence % 2 = 0 then 'cached' else 'hot' end as state from receipts where sequence <= 2500""",
    ("receipts",),
)
def cursor_pages(spark, folder):
    """Pages over live and cached bodies at a stored cursor: read, lost, read again, acknowledged."""
    bindings = checkpointed(receipts(spark, folder))
    head = head_of(spark, folder)
    bodies = bindings.select("sequence", "body")
    even = F.col("sequence") % 2 == 0
    read = hot_and_cached_range(bindings, bodies.where(~even), bodies.where(even), head)
    cursors = PageCursors(spark, fresh_folder(spark, "cursors"))
    cursors.save("other", "kept")
    store, pages = "ab" * 16, []
    for step in range(4):
        page = next_page(read, store, head, cursors, "billing", 1000 if step < 3 else 500)
        pages.append(page.rows.select("sequence", "event_id", F.octet_length("body").alias("bytes"), "state"))
        if step != 1:  # the second page is not acknowledged, as if its reader had died
            cursors.save("billing", page.next_cursor)
    if cursors.load("other") != "kept":
        raise LookupError("another consumer's cursor was changed")
    if not pages[1].exceptAll(pages[2]).isEmpty():
        raise LookupError("a page that was not acknowledged must come again")
    return pages[0].unionByName(pages[2]).unionByName(pages[3])


@query(
    "compacted_online",
    """with last as (select bucket, key, arg_max(value, generation) as value, arg_max(kind, generation) as kind from change_log group by 1,2)
select bucket, key, value from last where kind='put'
union all select bucket, key, value from snapshot where key not in (select key from last)""",
    ("change_log", "snapshot"),
)
def compacted_online(spark, folder):
    """A snapshot rewritten while its log grows: the log's later parts arrive between the rounds."""
    path = fresh_folder(spark, "online")
    log = derived(spark, folder, "change_log")
    head = log.agg(F.max("generation")).first()[0]
    end = head - 20  # the last writes come late enough to be caught up in the final round
    bounds = [0, end // 2, 3 * end // 4, end, head]
    sets = log.select("generation", F.array(F.struct(
        "bucket", "key", "kind", "value", F.lit(None).cast("bigint").alias("sequence"))).alias("writes"))

    def arrive(number: int) -> None:
        if number + 1 < len(bounds):
            low, high = bounds[number], bounds[number + 1]
            sets.where((F.col("generation") > low) & (F.col("generation") <= high)).write.parquet(
                f"{path}/log/part={number}")

    table = snapshot_table(spark, f"{path}/snapshots")
    arrive(0)
    publish_snapshot(table, derived(spark, folder, "snapshot"), 0)
    compact_online(
        table, lambda after: read_change_log(spark, f"{path}/log/*", after),
        between=lambda r: arrive(r + 1), max_seconds=600)
    rows, generation = current_snapshot(table)
    if generation != head:
        raise LookupError(f"the snapshot ends at {generation} and not at {head}")
    return rows


_SUMS = "||':'||".join(f"cast(sum(cast('0x'||substr(d,{1 + 8 * i},8) as bigint)) as varchar)" for i in range(8))


def _multiset_sql(rows: str) -> str:
    """The fingerprint text of a table (sequence, event_id, content_sha256, record_sha256)."""
    told = "||".join(
        f"'V'||octet_length(encode(cast({c} as varchar)))||':'||{c}"
        for c in ("sequence", "event_id", "content_sha256", "record_sha256"))
    return f"(select count(*)||':'||{_SUMS} from (select sha256({told}) as d from {rows}))"


@query(
    "snapshot_fingerprint",
    f"""with damaged as (select sequence, event_id, content_sha256, case when sequence = 7 then 'x' else record_sha256 end as record_sha256 from receipts)
select 'copy' as side, '' as detail union all select 'damaged', {_multiset_sql('damaged')}
union all select 'source', {_multiset_sql('receipts')}""",
    ("receipts",),
)
def snapshot_fingerprint(spark, folder):
    """Three committed batches whose fingerprints add up; an equal copy in another order and one with
    a single changed digest, which only the fingerprint rule of the audit can tell."""
    path = fresh_folder(spark, "fingerprints")
    rows = checkpointed(receipts(spark, folder))
    table = receipt_table(spark, f"{path}/receipts")
    columns = [c.split()[0] for c in table.schema.split(", ")]
    log = FingerprintLog(table, f"{path}/log")
    for number in range(3):
        table.write(rows.where(F.col("sequence") % 3 == number).select(*columns), number)
        table.commit(number)
        log.record(number)
    total = log.total()
    kept = total.select("fingerprint").first()[0]
    state = StoreState("prod", "ab" * 16, head_of(spark, folder))

    def found(copy: DataFrame) -> DataFrame:
        rules = audit_snapshot(
            state, state.store_id, state.head, copy, copy, ["env-0", "env-1"], kept)
        return rules.where(F.col("rule") == "fingerprint")

    damaged = rows.withColumn(
        "record_sha256", F.when(F.col("sequence") == 7, "x").otherwise(F.col("record_sha256")))
    copy = found(rows.repartition("event_id")).agg(
        F.coalesce(F.max("detail"), F.lit("")).alias("detail"))
    return (
        copy.select(F.lit("copy").alias("side"), "detail")
        .unionByName(found(damaged).select(F.lit("damaged").alias("side"), "detail"))
        .unionByName(total.select(F.lit("source").alias("side"), F.col("fingerprint").alias("detail")))
    )


@query(
    "capture_manifest",
    """with n as (select count(*) as c from usage_text where event_type in ('click','purchase'))
select c as record_count, cast(1 as bigint) as from_sequence, c as through_sequence, c as high_water, cast(0 as bigint) as violations,
 'promoted' as outcome, 'unchanged' as again, '' as findings, 'bindings_digest' as findings_bad, true as contiguous from n""",
    ("usage_text",),
)
def capture_manifest_query(spark, folder):
    """Sound receipts captured, described by a manifest, checked against its rules, promoted to the
    catalog twice, and audited from the written export, also with a wrong digest of the bindings."""
    path = fresh_folder(spark, "captured")
    table = receipt_table(spark, f"{path}/receipts")
    events = usage_receipt_events(spark, folder)
    sound = F.col("event_id").rlike("-(click|purchase)$")
    commit_receipts(table, events.where(sound), 0, "2024-02-01 00:00:00")
    stored, head = scan_receipts(table), table.head()
    capture = capture_export(stored, 0, 0, head, ["prod"], part_bytes=1 << 20)
    identity = SetIdentity(
        "set-1", "prod", "stack", "ab" * 16, "key-1", "2024-02-02 00:00:00", ("prod",), ("ef" * 32,))
    manifest, parts = capture_manifest(capture, stored, identity, part_bytes=1 << 20)
    violations = manifest_violations(manifest, parts).count()

    uploaded = manifest.withColumn("status", F.lit("uploaded"))
    verified = manifest.withColumn("verified_at", F.lit("2024-02-03 00:00:00").cast("timestamp_ntz"))
    now = "2024-02-03 00:00:00"
    promoted = checkpointed(promote_catalog(uploaded, verified, manifest.limit(0), now))
    again = promote_catalog(uploaded, verified, promoted, now)

    write_exports(capture.lines, f"{path}/export")
    exports = checkpointed(read_exports(spark, f"{path}/export").drop("decode_error"))
    told = manifest.select(
        "from_sequence", "through_sequence", "record_count", "high_water",
        F.col("max_received_at").cast("string").alias("max_received_at"),
        F.col("bindings_sha256").alias("root_sha256"),
    ).first().asDict()

    def findings(**changes) -> DataFrame:
        rules = audit_exports(exports, stored, {**told, "environments": ["prod"], **changes}, 0, 0)
        return rules.agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("f"))

    offsets = parts.groupBy("kind").agg(
        (F.sum("plain_bytes") == F.max(F.col("byte_offset") + F.col("plain_bytes"))).alias("whole"))
    return manifest.select(
        "record_count", "from_sequence", "through_sequence", "high_water",
        F.lit(violations).cast("bigint").alias("violations"),
        promoted.select("outcome").scalar().alias("outcome"), again.select("outcome").scalar().alias("again"),
        findings().scalar().alias("findings"),
        findings(root_sha256="0" * 64).scalar().alias("findings_bad"),
        offsets.agg(F.bool_and("whole")).scalar().alias("contiguous"),
    )


QUEUED = 3000  # every queued body is padded to this size, so that SQL knows the size of a file
_FILES = f"""b as (select distinct event_id//10 as batch_no from events), n as (select count(*) as c from b),
f as (select batch_no*16//c as q, count(*)*{QUEUED + 1} as size from b, n group by 1),
t as (select sum(size)//3 as cap, sum(size) as total from f),
over as (select q, size from (select q, size, coalesce(sum(size) over (order by q rows between unbounded preceding and 1 preceding),0) as older from f), t
 where older<total-cap)"""


@query(
    "stream_backlog_cap",
    f"""with {_FILES}
select 'dropped' as kind, 'q='||lpad(cast(q as varchar),2,'0') as name, size as bytes from over
union all select 'event', 'e-'||event_id, 0 from events e, n where (event_id//10)%10 not in (3,5,8) and (event_id//10)*16//c not in (select q from over)""",
)
def stream_backlog_cap(spark, folder):
    """A queue of three times its cap: the oldest files are dropped, recorded and never read, the rest
    is replayed. A second trim finds nothing more."""
    path = fresh_folder(spark, "capped")
    bodies = ingest_bodies(spark, folder)
    count = bodies.count()
    queued = bodies.select(
        F.lpad(F.expr(f"batch_no * 16 div {count}").cast("string"), 2, "0").alias("q"),
        F.rpad("body", QUEUED, " ").alias("value"))
    queued.repartition("q").write.partitionBy("q").text(f"{path}/in")
    ledger = BacklogLedger(spark, f"{path}/in", f"{path}/dropped", count * (QUEUED + 1) // 3, "*.txt")
    ledger.trim()
    if ledger.trim():
        raise LookupError("a queue under its cap must stay as it is")
    sink = EventSink(spark, f"{path}/store")
    source = batch_stream(spark, f"{path}/in/*", whole_files=False)
    drain(forward_batches(source, sink, f"{path}/checkpoint"))
    dropped = ledger.dropped.read().groupBy(
        F.regexp_extract("path", "(q=[0-9]+)/", 1).alias("name")).agg(F.sum("size").alias("bytes"))
    events = sink.events.read().select("event_id").distinct()
    return dropped.select(F.lit("dropped").alias("kind"), "name", "bytes").unionByName(
        events.select(F.lit("event").alias("kind"), F.col("event_id").alias("name"),
                      F.lit(0).cast("bigint").alias("bytes")))


@query(
    "stream_status",
    """select 1 as step, 'batch 0' as cursor, count(*) as uploaded, '2024-01-01 00:00:01' as uploaded_at, false as degraded, '' as error from events
union all select 2, 'batch 0', count(*), '2024-01-01 00:00:01', true, 'the store is away' from events
union all select 3, 'batch 1', 1, '2024-01-01 00:00:02', false, '' from (select 1)""",
)
def stream_status(spark, folder):
    """The status table after a good micro-batch, after a failing one, and after its repetition."""
    path = fresh_folder(spark, "status")
    lines = journal_lines(spark, folder).select(F.col("line").alias("value"))
    table, sink, times = StatusTable(spark, f"{path}/status"), EventSink(spark, f"{path}/store"), []

    def now() -> str:
        times.append(None)
        return f"2024-01-01 00:00:0{len(times)}"

    def run(broken: bool) -> None:
        def parse(df: DataFrame) -> DataFrame:
            if broken:
                raise Stopped("the store is away")
            return parse_journal(df, JournalConfig(env="staging"))

        source = line_stream(spark, f"{path}/in/*")
        drain(forward_lines(source, sink, f"{path}/checkpoint", parse, Tracking(table, "journal", now)))

    def seen(step: int) -> DataFrame:
        return checkpointed(table.read().select(
            F.lit(step).alias("step"), "cursor", F.col("last_uploaded_count").alias("uploaded"),
            F.col("last_upload_at").alias("uploaded_at"), "degraded", F.col("last_error").alias("error")))

    lines.write.text(f"{path}/in/a")
    run(False)
    states = [seen(1)]
    lines.orderBy("value").limit(1).write.text(f"{path}/in/b")
    try:
        run(True)
    except Exception as error:  # the stream wraps what its handler raised
        if "the store is away" not in str(error):
            raise
    states.append(seen(2))
    run(False)
    return states[0].unionByName(states[1]).unionByName(seen(3))


@query(
    "queue_listing",
    f"""with {_FILES}
select 'q='||lpad(cast(q as varchar),2,'0') as name, size, sum(size) over (order by q) as through from f""",
)
def queue_listing(spark, folder):
    """Queued files listed by name and size alone, with the bytes up to each in replay order."""
    path = fresh_folder(spark, "queue")
    bodies = ingest_bodies(spark, folder)
    count = bodies.count()
    bodies.select(
        F.lpad(F.expr(f"batch_no * 16 div {count}").cast("string"), 2, "0").alias("q"),
        F.rpad("body", QUEUED, " ").alias("value"),
    ).repartition("q").write.partitionBy("q").text(f"{path}/in")
    files = list_backlog(spark, f"{path}/in", "*.txt")
    placed = ordered_blocks(files, ["path"])
    sized = running(placed, "order_no", sums={"through": F.col("size")}, block=ORDERED_BLOCK)
    return sized.select(F.regexp_extract("path", "(q=[0-9]+)/", 1).alias("name"), "size", "through")
