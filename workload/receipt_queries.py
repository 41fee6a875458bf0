"""Queries over usage events and receipts: digests, append, paging, exports, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.functions.canonical import canonical_json
from tallylog.functions.identity import content_digest, record_digest
from tallylog.functions.usage import canonical_usage, usage_bindings, usage_facts
from tallylog.operators.packing import pack_greedy
from tallylog.operators.scan import sequence_gaps
from tallylog.plans.audit import bindings_fingerprint
from tallylog.plans.export import (
    archive_path, audit_exports, decode_exports, export_line, manifest_violations, part_totals,
    range_digests, reconcile_exports,
)
from tallylog.plans.receipts import (
    append_receipts, hot_or_cached, page_index, page_rows, usage_envelope,
)
from tallylog.schema import conform_events
from workload.registry import query
from workload.tables import STORE, base, derived


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "receipts").withColumn("is_legacy", F.lit(False))


def head_of(spark: SparkSession, folder: str) -> int:
    """The highest sequence, which a store keeps as a counter."""
    return base(spark, folder, "events").agg(F.max("event_id") + 1).first()[0]


# --- usage -----------------------------------------------------------------------------------

_USAGE_ID = """case when event_type='click' then 'usage-'||left(sha256('mqtt'||chr(0)||'brand-'||user_id||chr(0)||'epoch-1'||chr(0)||user_id||chr(0)
 ||window_day||'T00:00:00.5Z'||chr(0)||window_day||'T23:59:59Z'),24) else 'u-'||user_id||'-'||window_day||'-'||event_type end"""
_USAGE_REASON = """case event_type when 'view' then 'invalid_event' when 'error' then 'invalid_measurement' when 'signup' then 'invalid_measurement' end"""


@query(
    "usage_facts",
    f"""select {_USAGE_ID} as usage_id, 'mqtt' as service_code, 'brand-'||user_id as brand_cloud_id, user_id as usage_sequence,
 metric_code, unit, case when metric_code='publish_bytes' then b else c end as quantity, cast(0 as bigint) as quantity_scale,
 cast(window_day as timestamp)+interval 500 milliseconds as window_start
from usage_text, (values ('publish_bytes','bytes'),('publish_count','requests')) m(metric_code,unit) where event_type in ('click','purchase')""",
    ("usage_text",),
)
def usage_facts_query(spark, folder):
    facts = usage_facts(canonical_usage(derived(spark, folder, "usage_text"), "usage_json"))
    return facts.drop("window_end", "meter_epoch")


@query(
    "usage_invalid",
    f"""select user_id, window_day, event_type, {_USAGE_REASON} as usage_reason from usage_text where {_USAGE_REASON} is not null""",
    ("usage_text",),
)
def usage_invalid(spark, folder):
    checked = canonical_usage(derived(spark, folder, "usage_text"), "usage_json")
    return checked.where(F.col("usage_reason").isNotNull()).select(
        "user_id", "window_day", "event_type", "usage_reason"
    )


@query(
    "usage_digests",
    f"""select user_id as sequence, usage_id, sha256('{{"usage_id":"'||usage_id||'","service_code":"mqtt","brand_cloud_id":"brand-'||user_id||'","event_time":"'||window_day
 ||'T23:59:59.123456Z","window_start":"'||window_day||'T00:00:00.5Z","window_end":"'||window_day||'T23:59:59Z","meter_epoch":"epoch-1","sequence":'||user_id
 ||',"source":"meter","measurements":[{{"metric_code":"publish_bytes","unit":"bytes","quantity":'||b||'}},{{"metric_code":"publish_count","unit":"requests","quantity":'||c||'}}]'
 ||case when event_type='purchase' then ',"dimensions":{{"region":"r\\u003c'||user_id||'","z":"1"}}' else '' end||'}}') as event_sha256
from (select *, {_USAGE_ID} as usage_id from usage_text) u where event_type in ('click','purchase') and user_id>0""",
    ("usage_text",),
)
def usage_digests(spark, folder):
    """Reconciliation bindings; a sequence of 0 is not a record."""
    rows = derived(spark, folder, "usage_text").select(
        F.col("user_id").alias("sequence"), F.sha2("usage_json", 256).alias("content_sha256"),
        "usage_json",
    )
    bound = usage_bindings(rows, "usage_json").where(F.col("binding_reason").isNull())
    return bound.select("sequence", "usage_id", "event_sha256")


# --- append ----------------------------------------------------------------------------------

_FIELDS = """'{"usage_event":{"a":'||c||',"b":'||b||'}}'"""
_CONTENT = f"""sha256('{{"ID":"'||event_id||'","Env":"'||env||'","Stream":"billing_usage","Source":"billing_usage","Time":"'
 ||strftime(ts,'%Y-%m-%dT%H:%M:%SZ')||'","Fields":'||canonical||'}}')"""
_RECEIPT_CTE = f"""
with judged as (select *, '{{"usage_event":{{"a":'||regexp_extract(fields,'"a":([0-9]+)',1)||',"b":'||regexp_extract(fields,'"b":([0-9]+)',1)||'}}}}' as canonical,
  case when source<>'billing_usage' then 'billing usage envelope required'
   when event_type='click' and copy=0 then 'billing usage envelope required'
   when event_type='click' then 'billing usage fields must not require redaction' end as error from receipt_events),
good as (select *, {_CONTENT} as content_sha256 from judged where error is null),
stored as (select event_id, content_sha256 from good where event_type='signup' and copy=0),
firsts as (select event_id, min(arrival) as first_arrival, arg_min(content_sha256, arrival) as first_digest from good group by 1),
bound as (select f.event_id, first_arrival, coalesce(s.content_sha256, first_digest) as digest, s.event_id is not null as is_stored
  from firsts f left join stored s on f.event_id=s.event_id),
fresh as (select event_id, first_arrival, (select count(*) from stored)+row_number() over (order by first_arrival) as sequence from bound where not is_stored)"""


def receipt_input(spark: SparkSession, folder: str):
    """(usage events with replays and conflicts, stored bindings, head)."""
    raw = derived(spark, folder, "receipt_events")
    events = conform_events(raw)
    stored = raw.where((F.col("event_type") == "signup") & (F.col("copy") == 0))
    stored = conform_events(stored)
    digest = content_digest(
        F.col("event_id"), F.col("env"), F.col("stream"), F.col("source"), F.col("ts"),
        F.col("ts_sub"), canonical_json(F.col("fields")),
    )
    bindings = stored.select("event_id", digest.alias("content_sha256"))
    return events, bindings, stored.count()


@query(
    "receipt_append",
    f"""{_RECEIPT_CTE}
select sequence, g.event_id, content_sha256, sha256('{{"sequence":"'||sequence||'","content_sha256":"'||content_sha256||'","event":{{"event_id":"'||g.event_id
 ||'","ts":"'||strftime(ts,'%Y-%m-%dT%H:%M:%SZ')||'","level":"info","msg":"usage","service":"meter","env":"'||env||'","version":"'||version
 ||'","host":"h1","unit":"u1","source":"billing_usage","stream":"billing_usage","fields":'||canonical||'}}}}') as record_sha256
from good g join fresh f on g.arrival=f.first_arrival""",
    ("receipt_events",),
)
def receipt_append(spark, folder):
    events, bindings, head = receipt_input(spark, folder)
    out = append_receipts(events, bindings, head, "2024-02-01 00:00:00", block=4096)
    return out.receipts.select("sequence", "event_id", "content_sha256", "record_sha256")


@query(
    "receipt_conflicts",
    f"""{_RECEIPT_CTE}
select g.arrival, g.event_id, case when not is_stored and g.arrival=first_arrival then 'accepted' when g.content_sha256=digest then 'duplicate' else 'rejected' end as status,
 case when (is_stored or g.arrival<>first_arrival) and g.content_sha256<>digest then 'billing event identity conflicts with stored content' end as error
from good g join bound b on g.event_id=b.event_id
union all select arrival, event_id, 'rejected', error from judged where error is not null""",
    ("receipt_events",),
)
def receipt_conflicts(spark, folder):
    events, bindings, head = receipt_input(spark, folder)
    return append_receipts(events, bindings, head, "2024-02-01 00:00:00").results


@query(
    "usage_envelope",
    f"""{_RECEIPT_CTE} select arrival, error as reject_reason from judged""",
    ("receipt_events",),
)
def usage_envelope_query(spark, folder):
    events = conform_events(derived(spark, folder, "receipt_events"))
    return usage_envelope(events).select("arrival", "reject_reason")


@query(
    "canonical_fields",
    """select arrival, case when event_type='click' and copy=0 then '{"other":1}' when event_type='click' then fields
 else '{"usage_event":{"a":'||regexp_extract(fields,'"a":([0-9]+)',1)||',"b":'||regexp_extract(fields,'"b":([0-9]+)',1)||'}}' end as canonical from receipt_events""",
    ("receipt_events",),
)
def canonical_fields(spark, folder):
    return derived(spark, folder, "receipt_events").select(
        "arrival", canonical_json(F.col("fields")).alias("canonical")
    )


# --- reading ---------------------------------------------------------------------------------

_PAGES = """
with recursive sized as (select sequence, cast(sum(length(body)) over (order by sequence) as bigint) as upto from receipts),
walk as (select cast(0 as bigint) as page_no, cast(0 as bigint) as from_sequence, cast(0 as bigint) as through_sequence, cast(0 as bigint) as upto
 union all
 select w.page_no+1, w.through_sequence+1, s.sequence, s.upto from walk w, lateral (select sequence, upto from sized
   where sequence>w.through_sequence and sequence<=w.through_sequence+1000 and (sized.upto<=w.upto+15300 or sequence=w.through_sequence+1) order by sequence desc limit 1) s)
select page_no, from_sequence, through_sequence, through_sequence-from_sequence+1 as record_count,
 upto-lag(upto) over (order by page_no) as page_bytes, through_sequence<(select max(sequence) from receipts) as has_more from walk qualify page_no>0"""


@query("receipt_pages", _PAGES, ("receipts",))
def receipt_pages(spark, folder):
    """All pages a consumer walks; the byte bound is small enough to cut some pages short."""
    head = head_of(spark, folder)
    return page_index(receipts(spark, folder), 0, head, 1000, 15300)


@query(
    "receipt_page",
    """with s as (select *, (select max(sequence)//2 from receipts) as start from receipts),
t as (select *, sum(length(body)) over (order by sequence) as size from s where sequence>start and sequence<=start+1000)
select sequence, content_sha256, body from t where size<=12000 or sequence=start+1""",
    ("receipts",),
)
def receipt_page(spark, folder):
    head = head_of(spark, folder)
    rows = page_rows(receipts(spark, folder), head // 2, head, 1000, 12000)
    return rows.select("sequence", "content_sha256", "body")


def split_store(spark: SparkSession, folder: str):
    """(all receipts, hot rows, cached rows, floor): half retired, some bodies lost."""
    rows = receipts(spark, folder)
    floor = head_of(spark, folder) // 2
    hot = rows.where(F.col("sequence") > floor).where(~F.col("body").startswith("signup:"))
    changed = F.when(F.col("body").startswith("view:"), F.concat("body", F.lit("!"))).otherwise(
        F.col("body")
    )
    cache = (
        rows.where(F.col("sequence") <= floor)
        .where(~F.col("body").startswith("error:"))
        .withColumn("body", changed)
    )
    return rows, hot, cache, floor


@query(
    "receipt_hot_or_cache",
    """with s as (select *, sequence<=(select max(sequence)//2 from receipts) as below, split_part(body,':',1) as kind from receipts)
select sequence, case when below and kind='error' then 'archive_unavailable' when below and kind='view' then 'corrupt' when below then 'cached'
 when kind='signup' then 'corrupt' else 'hot' end as state from s""",
    ("receipts",),
)
def receipt_hot_or_cache(spark, folder):
    rows, hot, cache, floor = split_store(spark, folder)
    return hot_or_cached(rows, hot, cache, floor).select("sequence", "state")


@query(
    "receipt_gaps",
    """with kept as (select sequence from receipts where body not like 'signup:%' union all select 0 union all select max(sequence)+1 from receipts)
select * from (select lag(sequence) over (order by sequence)+1 as gap_from, sequence-1 as gap_through from kept) g where gap_from<=gap_through""",
    ("receipts",),
)
def receipt_gaps(spark, folder):
    head = head_of(spark, folder)
    kept = receipts(spark, folder).where(~F.col("body").startswith("signup:"))
    return sequence_gaps(
        kept, "sequence", F.lit(1).cast("bigint"), F.lit(head).cast("bigint")
    )


# --- exports ---------------------------------------------------------------------------------

@query(
    "export_parts",
    """
with recursive sized as (select doc_id+1 as sequence, cast(sum(octet_length(encode(text))) over (order by doc_id) as bigint) as upto from documents),
walk as (select cast(0 as bigint) as ordinal, cast(0 as bigint) as from_sequence, cast(0 as bigint) as through_sequence, cast(0 as bigint) as upto
 union all
 select w.ordinal+1, w.through_sequence+1, s.sequence, s.upto from walk w, lateral (select sequence, upto from sized
   where sequence>w.through_sequence and (sized.upto<=w.upto+1048576 or sequence=w.through_sequence+1) order by sequence desc limit 1) s)
select ordinal, from_sequence, through_sequence, through_sequence-from_sequence+1 as record_count, upto-lag(upto) over (order by ordinal) as plain_bytes,
 lag(upto) over (order by ordinal) as byte_offset from walk qualify ordinal>0""",
)
def export_parts(spark, folder):
    """Document texts packed into parts of at most 1 MiB."""
    docs = base(spark, folder, "documents").select(
        (F.col("doc_id") + 1).alias("sequence"), F.octet_length("text").alias("size")
    )
    return pack_greedy(docs, "sequence", "size", 1 << 20)


@query(
    "export_records",
    """select sequence, content_sha256, received_at, '{"k":"'||split_part(body,':',1)||'"}' as record, cast(null as varchar) as decode_error
from receipts where body not like 'view:%'
union all select sequence, content_sha256, received_at, '{"k":"view"}', 'unknown member' from receipts where body like 'view:%'""",
    ("receipts",),
)
def export_records(spark, folder):
    """Export lines rendered and strictly read back; view records carry an unknown member."""
    rows = receipts(spark, folder).withColumn("kind", F.substring_index("body", ":", 1))
    lines = rows.withColumn("body", F.concat(F.lit('{"k":"'), "kind", F.lit('"}'))).select(
        "kind", export_line().alias("line")
    )
    line = F.when(
        F.col("kind") == "view", F.concat(F.lit('{"extra":1,'), F.substr("line", F.lit(2)))
    ).otherwise(F.col("line"))
    return decode_exports(lines.select(line.alias("line")))


def set_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Event parts of 100 receipts per set of 600, with planted errors in some sets."""
    rows = receipts(spark, folder).select(
        F.expr("(sequence-1) div 600").alias("set_no"),
        (F.expr("((sequence-1) % 600) div 100") + 1).alias("n"),
        F.octet_length("body").alias("size"),
    )
    parts = rows.groupBy("set_no", "n").agg(F.sum("size").alias("plain_bytes"))
    return parts.select(
        F.concat(F.lit("set-"), "set_no").alias("set_id"),
        F.concat(F.lit("p"), F.when((F.col("set_no") % 5 == 2) & (F.col("n") == 3), 2)
                 .otherwise(F.col("n"))).alias("name"),
        F.lit("events").alias("kind"),
        F.when((F.col("set_no") % 5 == 1) & (F.col("n") >= 4), F.col("n") + 1)
        .otherwise(F.col("n")).alias("ordinal"),
        F.col("n"), F.col("set_no"), "plain_bytes",
        (F.col("plain_bytes") + 16).alias("sealed_bytes"),
        F.sha2(F.concat_ws("-", "set_no", "n"), 256).alias("plain_sha256"),
        F.when((F.col("set_no") % 5 == 3) & (F.col("n") == 1), F.lit("bad"))
        .otherwise(F.sha2(F.concat_ws("+", "set_no", "n"), 256)).alias("sealed_sha256"),
    )


_PARTS_SQL = """
with sized as (select (sequence-1)//600 as set_no, ((sequence-1)%600)//100+1 as n, sum(length(body)) as bytes from receipts group by 1,2),
placed as (select *, coalesce(sum(bytes) over (partition by set_no order by n rows between unbounded preceding and 1 preceding),0) as expected from sized),
totals as (select set_no, sum(bytes) as total from sized group by 1)"""


@query(
    "manifest_violations",
    f"""{_PARTS_SQL}
select 'set-'||set_no as set_id, 'part_order' as rule, 'events/5' as detail from placed where set_no%5=1 and n=4
union all select 'set-'||set_no, 'part_name', 'p2' from placed where set_no%5=2 and n=3
union all select 'set-'||set_no, 'part', 'p1' from placed where set_no%5=3 and n=1
union all select 'set-'||set_no, 'part_offset', 'events/'||n from placed where set_no%5=4 and n=2
union all select 'set-'||set_no, 'range', '' from (select (sequence-1)//600 as set_no, count(*) as c from receipts group by 1) s where c<>600
union all select 'set-'||set_no, 'environments', '' from (select distinct (sequence-1)//600 as set_no from receipts) s where set_no%7=0
union all select 'set-'||set_no, 'identity', '' from (select distinct (sequence-1)//600 as set_no from receipts) s where set_no%7=1
union all select 'set-'||set_no, 'totals', '' from (select distinct (sequence-1)//600 as set_no from receipts) s""",
    ("receipts",),
)
def manifest_violations_query(spark, folder):
    """Sets with event parts only, so each lacks its snapshot; other errors are planted by set."""
    parts = set_parts(spark, folder)
    from pyspark.sql import Window

    earlier = Window.partitionBy("set_no").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("plain_bytes").over(earlier), F.lit(0))
    wrong = (F.col("set_no") % 5 == 4) & (F.col("n") == 2)
    parts = parts.withColumn("byte_offset", offset + F.when(wrong, 1).otherwise(0))
    rows = receipts(spark, folder)
    sets = rows.groupBy(F.expr("(sequence-1) div 600").alias("set_no")).agg(
        F.min("sequence").alias("from_sequence"),
        F.count(F.lit(1)).alias("n"),
        F.max("received_at").alias("max_received_at"),
    )
    manifests = sets.select(
        F.concat(F.lit("set-"), "set_no").alias("set_id"),
        F.lit(1).alias("version"), F.lit("prod").alias("environment"),
        F.lit("stack").alias("stack"), F.lit(STORE).alias("store_id"),
        F.when(F.col("set_no") % 7 == 1, "Bad Key").otherwise("key-1").alias("encryption_key_id"),
        F.when(F.col("set_no") % 7 == 0, F.array(F.lit("prod"), F.lit("prod")))
        .otherwise(F.array(F.lit("prod"))).alias("source_environments"),
        F.col("max_received_at").alias("created_at"), "max_received_at", "from_sequence",
        (F.col("from_sequence") + 599).alias("through_sequence"),
        (F.col("from_sequence") + 599).alias("high_water"),
        F.col("n").alias("record_count"),
        F.sha2(F.lit("x"), 256).alias("snapshot_sha256"),
        F.sha2(F.lit("y"), 256).alias("bindings_sha256"),
        F.lit(100).alias("snapshot_bytes"),
        F.array(F.sha2(F.lit("z"), 256)).alias("recipient_fingerprints"),
    )
    return manifest_violations(manifests, parts)


@query(
    "part_totals",
    f"""{_PARTS_SQL}
select 'set-'||set_no as set_id, 'events' as kind, cast(sum(bytes) as bigint) as total_bytes, count(*) as part_count,
 cast(max(case when set_no%5=1 and n>=4 then n+1 else n end) as bigint) as max_ordinal from placed group by set_no""",
    ("receipts",),
)
def part_totals_query(spark, folder):
    return part_totals(set_parts(spark, folder))


@query(
    "archive_paths",
    f"""select set_no, 'billing-raw/stack/{STORE}/'||strftime(created_at,'%Y/%m/%d')||'/'||set_id||'/p1' as raw_path,
 'billing-inbox-snapshots/stack/{STORE}/'||strftime(created_at,'%Y/%m/%d')||'/'||set_id||'/p1' as snapshot_path from catalog""",
    ("catalog",),
)
def archive_paths(spark, folder):
    def path(kind: str):
        return archive_path(
            F.lit(kind), F.lit("stack"), F.lit(STORE), F.col("created_at"), F.col("set_id"),
            F.lit("p1"),
        )

    return derived(spark, folder, "catalog").select(
        "set_no", path("events").alias("raw_path"), path("snapshot").alias("snapshot_path")
    )


def usage_refs(spark: SparkSession, folder: str) -> DataFrame:
    return receipts(spark, folder).select(
        "sequence", "content_sha256", "received_at",
        F.concat(F.lit("usage-"), "event_id").alias("usage_id"),
        F.col("record_sha256").alias("event_sha256"),
    )


_REF_JSON = """'{"sequence":"'||sequence||'","logger_content_sha256":"'||content_sha256||'","usage_id":"usage-'||event_id||'","event_sha256":"'||record_sha256||'"}'"""


@query(
    "range_digests",
    f"""select (sequence-1)//1000 as range_no, min(sequence) as from_sequence, max(sequence) as through_sequence, count(*) as record_count,
 max(received_at) as max_received_at, sha256('['||string_agg({_REF_JSON}, ',' order by sequence)||']') as bindings_sha256,
 max(sequence)-min(sequence)+1=count(*) as contiguous from receipts group by 1""",
    ("receipts",),
)
def range_digests_query(spark, folder):
    return range_digests(usage_refs(spark, folder))


@query(
    "bindings_fingerprint",
    """with leaves as (select sequence-1 as n, sha256('{"event_id":"'||event_id||'","sequence":"'||sequence||'","content_sha256":"'||content_sha256||'","record_sha256":"'||record_sha256||'"}') as d from receipts),
l1 as (select n//1000 as n, sha256(string_agg(d,'' order by n)) as d from leaves group by 1),
l2 as (select n//1000 as n, sha256(string_agg(d,'' order by n)) as d from l1 group by 1),
l3 as (select n//1000 as n, sha256(string_agg(d,'' order by n)) as d from l2 group by 1)
select sha256(string_agg(d,'' order by n)) as root_sha256 from l3""",
    ("receipts",),
)
def bindings_fingerprint_query(spark, folder):
    return bindings_fingerprint(receipts(spark, folder))


def damaged_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Exports of all receipts: signups are missing, errors have another time, views another body
    and purchases appear twice."""
    rows = receipts(spark, folder).where(~F.col("body").startswith("signup:"))
    shifted = F.when(
        F.col("body").startswith("error:"), F.col("received_at") + F.expr("interval 1 second")
    ).otherwise(F.col("received_at"))
    record = F.when(F.col("body").startswith("view:"), F.upper("body")).otherwise(F.col("body"))
    out = rows.select(
        "sequence", "content_sha256", shifted.alias("received_at"), record.alias("record")
    )
    twice = out.where(F.col("record").startswith("purchase:"))
    return out.unionByName(twice)


@query(
    "export_reconcile",
    """select sequence, 'not_exported' as reason from receipts where body like 'signup:%'
union all select sequence, 'time' from receipts where body like 'error:%'
union all select sequence, 'body' from receipts where body like 'view:%'
union all select sequence, 'repeated' from receipts where body like 'purchase:%'""",
    ("receipts",),
)
def export_reconcile(spark, folder):
    head = head_of(spark, folder)
    return reconcile_exports(
        damaged_exports(spark, folder), receipts(spark, folder), 1, head, ["env-0", "env-1"]
    )


@query(
    "audit_exports",
    """with half as (select max(sequence)//2 as h, max(sequence) as top from receipts), r as (select receipts.*, h, top from receipts, half where sequence>h),
kept as (select sequence from r where body not like 'signup:%' union all select h from half union all select top+1 from half)
select 'record:environment' as rule, cast(sequence as varchar) as detail from r where env='env-1' and body not like 'signup:%'
union all select 'record:not_exported', cast(sequence as varchar) from r where body like 'signup:%'
union all select 'gap', (f)||'-'||(t) from (select lag(sequence) over (order by sequence)+1 as f, sequence-1 as t from kept) g where f<=t
union all select 'count', cast(top-h-1 as varchar) from half
union all select 'max_time', strftime(m, '%Y-%m-%d %H:%M:%S')||rtrim('.'||lpad(cast(microsecond(m)%1000000 as varchar),6,'0'),'0') from (select max(received_at) as m from r where body not like 'signup:%') x""",
    ("receipts",),
)
def audit_exports_query(spark, folder):
    """The second half of the store was exported without signups and with a wrong manifest."""
    head = head_of(spark, folder)
    half = head // 2
    rows = receipts(spark, folder).where(F.col("sequence") > half)
    exports = rows.where(~F.col("body").startswith("signup:")).select(
        "sequence", "content_sha256", "received_at", F.col("body").alias("record")
    )
    manifest = {
        "from_sequence": half + 1, "through_sequence": head, "record_count": head - half - 1,
        "high_water": head, "max_received_at": "2030-01-01 00:00:00", "environments": ["env-0"],
    }
    return audit_exports(exports, rows, manifest, half, half // 2)


@query(
    "record_digests",
    "select sequence, record_sha256 from receipts",
    ("receipts",),
)
def record_digests(spark, folder):
    return receipts(spark, folder).select(
        "sequence", record_digest(F.col("body")).alias("record_sha256")
    )
