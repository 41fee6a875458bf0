"""Queries over log events: parsing, redaction, validation, labels, ingest and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.functions.identity import container_event_id
from tallylog.functions.labels import label_key, label_set, retention_policy, retention_tier
from tallylog.functions.levels import normalize_level
from tallylog.functions.redact import redact_fields, redact_text
from tallylog.operators.dedupe import first_wins
from tallylog.operators.query import EventQuery, query_events
from tallylog.operators.validate import missing_field, route_reason
from tallylog.plans.ingest import append_unique, ingest_events
from tallylog.schema import conform_events
from tallylog.sources.access import request_events
from tallylog.sources.batches import batch_events, check_batches, quarantine
from tallylog.sources.containers import ContainerConfig, parse_container
from tallylog.sources.events import label_events
from tallylog.sources.journal import JournalConfig, initial_window, parse_journal
from workload.registry import query
from workload.tables import base, derived, spread

_MARKERS = "authorization|bearer |password|secret|token|payload|private key|-----begin"
_SAFE_MSG = f"case when regexp_matches(lower(msg),'{_MARKERS}') then '[REDACTED]' else msg end"


def log_events(spark: SparkSession, folder: str) -> DataFrame:
    return conform_events(spread(derived(spark, folder, "log_events")))


_EVENT_OUT = (
    "event_id", "ts", "level", "msg", "service", "env", "version", "host", "unit", "source",
    "request_id", "device_id", "org_id", "status_code", "outcome",
)


def _event_sql(where: str, order: str, limit: int) -> str:
    columns = ", ".join(c for c in _EVENT_OUT if c != "msg")
    return f"""
with visible as (select *, {_SAFE_MSG} as safe from log_events
  where trim(msg)<>'' and source<>'billing_usage' and stream<>'billing_usage' and {where}),
firsts as (select * from visible qualify row_number() over (partition by event_id order by arrival)=1)
select {columns}, safe as msg from firsts order by ts {order}, event_id {order} limit {limit}"""


@query(
    "event_query_desc",
    _event_sql("env='prod' and ts>=timestamp '2024-01-03 00:00:00' and ts<=timestamp '2024-01-20 12:00:00'",
               "desc", 1000),
    ("log_events",),
)
def event_query_desc(spark, folder):
    q = EventQuery(
        since="2024-01-03T00:00:00Z", until="2024-01-20T12:00:00Z", env="prod", limit=1000
    )
    accepted = ingest_events(log_events(spark, folder)).accepted
    return query_events(accepted, q, dedupe=False).select(*_EVENT_OUT)


@query(
    "event_query_asc",
    _event_sql("level='error' and status_class='5xx' and unit='error.service'", "asc", 500),
    ("log_events",),
)
def event_query_asc(spark, folder):
    q = EventQuery(
        level="error", status_class="5xx", unit="error.service", order="asc", limit=500
    )
    accepted = ingest_events(log_events(spark, folder)).accepted
    return query_events(accepted, q, dedupe=False).select(*_EVENT_OUT)


@query(
    "event_dedupe",
    """select event_id, arrival, ts, env from arrivals
qualify row_number() over (partition by event_id order by arrival)=1""",
    ("arrivals",),
)
def event_dedupe(spark, folder):
    return first_wins(derived(spark, folder, "arrivals")).select(
        "event_id", "arrival", "ts", "env"
    )


@query(
    "event_validate",
    """select arrival, case when trim(msg)='' then 'msg is required' end as reject_reason from log_events""",
    ("log_events",),
)
def event_validate(spark, folder):
    return log_events(spark, folder).select("arrival", missing_field().alias("reject_reason"))


@query(
    "event_count",
    "select count(*) as events, count(distinct event_id) as ids from log_events where trim(msg)<>''",
    ("log_events",),
)
def event_count(spark, folder):
    valid = log_events(spark, folder).where(missing_field().isNull())
    return valid.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids")
    )


@query(
    "event_ids",
    """select arrival, event_id, 'docker-log-'||left(sha256('gateway'||chr(0)||cast(ts as varchar)||chr(0)||msg),24) as container_id
from log_events""",
    ("log_events",),
)
def event_ids(spark, folder):
    # The journal id itself is computed from its parts by ``journal_events``.
    return log_events(spark, folder).select(
        "arrival", "event_id",
        container_event_id(F.lit("gateway"), F.col("ts").cast("string"), F.col("msg")).alias(
            "container_id"
        ),
    )


@query(
    "redact_message",
    f"""select doc_id, case when regexp_matches(lower(text),'{_MARKERS}') then '[REDACTED]' else text end as msg
from documents""",
)
def redact_message(spark, folder):
    return base(spark, folder, "documents").select("doc_id", redact_text(F.col("text")).alias("msg"))


_LEVEL_INPUT = "case when event_id%2=0 then upper(event_type) else ' '||event_type||' ' end"


@query(
    "normalize_levels",
    """select event_id, case when event_type='error' then 'error' else 'info' end as level,
case when value<100 then 'warn' else 'info' end as other from events""",
)
def normalize_levels(spark, folder):
    events = base(spark, folder, "events")
    spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(
        F.concat(F.lit(" \t"), "event_type", F.lit(" "))
    )
    return events.select(
        "event_id", normalize_level(spelled).alias("level"),
        normalize_level(F.when(F.col("value") < 100, "Warning").otherwise("verbose")).alias("other"),
    )


def journal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Journal export lines rendered from events: JSON messages, plain messages, broken lines."""
    e = spread(base(spark, folder, "events"))
    inner = F.to_json(
        F.struct(
            F.lit("handled").alias("msg"), F.col("event_type").alias("service"),
            F.col("user_id").alias("user_id"), F.lit(200).alias("status_code"),
            F.col("event_id").alias("attempt"), F.lit("raw").alias("access_token"),
        )
    )
    message = F.when(F.col("event_type") == "click", inner).otherwise(
        F.concat("event_type", F.lit(" done "))
    )
    line = F.to_json(
        F.struct(
            F.concat(F.lit("s="), "event_id").alias("__CURSOR"),
            F.lit("boot-1").alias("_BOOT_ID"),
            F.concat(F.lit("host-"), F.col("user_id") % 7).alias("_HOSTNAME"),
            F.concat("event_type", F.lit(".service")).alias("_SYSTEMD_UNIT"),
            message.alias("MESSAGE"),
            (F.col("event_id") % 8).cast("string").alias("PRIORITY"),
            F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias(
                "__REALTIME_TIMESTAMP"
            ),
            F.concat(F.lit("req-"), "event_id").alias("REQUEST_ID"),
        )
    )
    broken = F.when(F.col("event_type") == "signup", F.concat(line, F.lit("{}"))).otherwise(line)
    return e.select(broken.alias("line"), F.col("event_id").alias("arrival"))


@query(
    "journal_events",
    """select event_id as arrival,
 case when event_type='signup' then null else sha256('host-'||(user_id%7)||chr(0)||'boot-1'||chr(0)||event_type||'.service'||chr(0)||'s='||event_id) end as event_id,
 case when event_type='signup' then null else ts end as ts,
 case when event_type='signup' then null when event_id%8<4 then 'error' when event_id%8=4 then 'warn' when event_id%8=7 then 'debug' else 'info' end as level,
 case when event_type='signup' then null when event_type='click' then 'handled' else event_type||' done' end as msg,
 case when event_type='signup' then null when event_type='click' then 'click' else event_type||'.service' end as service,
 case when event_type='signup' then null else 'staging' end as env,
 case when event_type='click' then cast(user_id as varchar) end as user_id,
 case when event_type='click' then '200' end as status_code,
 case when event_type='signup' then null else 'req-'||event_id end as request_id,
 case when event_type='click' then '{"access_token":"[REDACTED]","attempt":'||event_id||'}' end as fields,
 case when event_type='signup' then 'not a JSON object' end as reject_reason
from events""",
)
def journal_events(spark, folder):
    parsed = parse_journal(journal_lines(spark, folder), JournalConfig(env="staging"))
    names = ("event_id", "ts", "level", "msg", "service", "env", "user_id", "status_code",
             "request_id", "fields")
    usable = F.col("reject_reason").isNull()
    return parsed.select(
        "arrival", *[F.when(usable, F.col(n)).alias(n) for n in names], "reject_reason"
    )


@query(
    "journal_numbers",
    """select event_id, '{"big":1.2345678901234568e+40,"cents":'||event_id*100||',"deep":[0.5,{"x":-3}],"half":'||event_id||'.5,"tiny":1e-7,"word":"1e2, 2.0"}' as fields from events""",
)
def journal_numbers(spark, folder):
    """Extra fields whose numbers are written in other ways than a 64-bit number is written."""
    e = spread(base(spark, folder, "events")).select("event_id", "ts")
    number = F.col("event_id").cast("string")
    message = F.concat(
        F.lit('{"msg":"m","half":'), number, F.lit('.50,"cents":'), number, F.lit('e2,"big":'),
        F.lit("12345678901234567890123456789012345678901"), F.lit(',"tiny":0.00000010,"deep":'),
        F.lit('[5e-1,{"x":-3.0}],"word":"1e2, 2.0"}'))
    line = F.to_json(F.struct(
        F.concat(F.lit("s="), number).alias("__CURSOR"), F.lit("b").alias("_BOOT_ID"),
        F.lit("h").alias("_HOSTNAME"), F.lit("u").alias("_SYSTEMD_UNIT"), message.alias("MESSAGE"),
        F.lit("1780297323000000").alias("__REALTIME_TIMESTAMP")))
    parsed = parse_journal(e.select(line.alias("line"), F.col("event_id").alias("arrival")))
    return parsed.select(F.col("arrival").alias("event_id"), "fields")


@query(
    "initial_window",
    """select event_id, ts from events where ts>=timestamp '2024-01-20 10:45:00'""",
)
def initial_window_query(spark, folder):
    events = base(spark, folder, "events").select("event_id", "ts")
    return initial_window(events, "1h15m", "2024-01-20 12:00:00")


@query(
    "container_events",
    f"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as raw,
   unnest(range(len(string_split(text, chr(10))))) as n from documents),
msgs as (select doc_id, n, regexp_replace(raw,'^[\\s\\x{{85}}\\pZ]+|[\\s\\x{{85}}\\pZ]+$','','g') as m from lines),
stamped as (select *, m='' as blank, '2024-01-01T00:00:'||lpad(cast(n%60 as varchar),2,'0')||'.'||lpad(cast(doc_id%1000 as varchar),3,'0')||'000456Z' as stamp from msgs),
timed as (select doc_id, n, blank, case when blank then '1970-01-01T00:00:00Z#'||(doc_id*100000+n) else stamp end as t,
  case when blank then stamp when regexp_matches(lower(m),'{_MARKERS}') then '[REDACTED]' else m end as m from stamped)
select doc_id*100000+n as arrival, 'docker-log-'||left(sha256('gateway'||chr(0)||t||chr(0)||m),24) as event_id,
 case when blank then timestamp '1970-01-01 00:00:00' else make_timestamp(2024,1,1,0,0,cast(n%60 as double)) + to_milliseconds(doc_id%1000) end as ts,
 cast(case when blank then 0 else 456 end as smallint) as ts_sub, cast(null as varchar) as reject_reason,
 case when contains(lower(m),'[error]') or contains(lower(m),' error') then 'error'
  when contains(lower(m),'[warning]') or contains(lower(m),' warning') then 'warn'
  when contains(lower(m),'[debug]') or contains(lower(m),' debug') then 'debug' else 'info' end as level,
 case when contains(lower(m),'publish') or contains(lower(m),'subscribe') then 'emqx broker mqtt trace' else 'emqx broker log' end as msg,
 'gateway' as service, m as log_line
from timed""",
)
def container_events(spark, folder):
    """Every line of every document as a container log line. A blank one is a time alone, which cannot
    be split: it is the message of a line without a time."""
    docs = spread(base(spark, folder, "documents")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")
    )
    stamp = F.concat(
        F.lit("2024-01-01T00:00:"), F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.lit("."),
        F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("000456Z"),
    )
    lines = docs.select(
        (F.col("doc_id") * 100000 + F.col("n")).alias("arrival"),
        F.concat(stamp, F.lit(" "), "raw").alias("line"),
    )
    parsed = parse_container(lines, ContainerConfig("gateway", env="prod", version="1", host="h"))
    return parsed.select(
        "arrival", "event_id", "ts", "ts_sub", "level", "msg", "service", "reject_reason",
        F.from_json("fields", "log_line string")["log_line"].alias("log_line"),
    )


@query(
    "request_events",
    """select page_id, method, coalesce(status,200) as status, micros/1000.0 as duration_ms, level, msg,
 case when page_id%3=0 then '2001:db8::'||page_id when page_id%3=1 then '10.0.0.'||(page_id%250) else 'unix' end as remote_addr,
 case when page_id%2=0 then 'req-'||page_id end as request_id,
 case when instr(target,'?')>0 then '/p/'||page_id||'?Api_Key=[REDACTED]&page=2&state=ok&token=[REDACTED]' else target end as path
from (select *, 'info' as level, 'http request' as msg from access) a""",
    ("access",),
)
def request_events_query(spark, folder):
    return request_events(derived(spark, folder, "access")).select(
        "page_id", "method", "status", "duration_ms", "level", "msg", "remote_addr", "request_id",
        "path",
    )


@query(
    "sanitize_paths",
    """select page_id, case when instr(url,'?')>0 then
 regexp_extract(url,'^[a-z]+://[^/?]*(/[^?]*)',1)||'?'||regexp_extract(url,'\\?([^#]*)',1)
  ||case when instr(url,'#')>0 then '%23'||regexp_extract(url,'#(.*)$',1) else '' end
 when instr(url,'#')>0 then regexp_replace(regexp_extract(url,'^[a-z]+://[^/?]*(/.*)$',1),'#','%23')
 else regexp_extract(url,'^[a-z]+://[^/?]*(/.*)$',1) end as path from pages""",
)
def sanitize_paths(spark, folder):
    from tallylog.functions.paths import sanitize_path

    return base(spark, folder, "pages").select("page_id", sanitize_path(F.col("url")).alias("path"))


def ingest_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Batch documents of ten consecutive events; some broken, some with trailing text."""
    e = base(spark, folder, "events")
    one = F.to_json(
        F.struct(
            F.concat(F.lit("e-"), "event_id").alias("event_id"),
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("ts"),
            F.lit("info").alias("level"), F.col("event_type").alias("msg"),
            F.lit("api").alias("service"), F.lit("prod").alias("env"), F.lit("v1").alias("version"),
            F.lit("h").alias("host"), F.lit("u").alias("unit"), F.lit("journald").alias("source"),
        )
    )
    grouped = e.groupBy(F.expr("event_id div 10").alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", one.alias("j")))).alias("rows")
    )
    text = F.concat(
        F.lit('{"events":['), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]}")
    )
    ending = F.col("batch_no") % 10
    body = (
        F.when(ending == 3, F.concat(text, F.lit("{}")))
        .when(ending == 5, F.left(text, F.length(text) - 2))
        .when(ending == 7, F.concat(text, F.rpad(F.lit(""), 4000, " ")))
        .when(ending == 8, F.lit('{"events":[{"event_id":1}]}'))
        .otherwise(text)
    )
    return grouped.select("batch_no", F.concat(F.lit("q/"), "batch_no").alias("path"),
                          body.alias("body"))


_BATCH_ERROR = """case batch_no%10 when 3 then 'invalid trailing json' when 5 then 'invalid json'
 when 7 then 'request body too large' when 8 then 'invalid json' end"""


@query(
    "batch_checks",
    f"""select batch_no, {_BATCH_ERROR} as batch_error from (select distinct event_id//10 as batch_no from events) b""",
)
def batch_checks(spark, folder):
    return check_batches(ingest_bodies(spark, folder), max_bytes=4000, max_events=10).select(
        "batch_no", "batch_error"
    )


@query(
    "batch_events",
    f"""select (event_id//10)*1048576+event_id%10 as arrival, 'e-'||event_id as event_id, ts, event_type as msg
from (select *, event_id//10 as batch_no from events) e where {_BATCH_ERROR} is null""",
)
def batch_events_query(spark, folder):
    checked = check_batches(ingest_bodies(spark, folder), max_bytes=4000, max_events=10)
    return batch_events(checked, "batch_no").select("arrival", "event_id", "ts", "msg")


@query(
    "quarantine_batches",
    """select 'q/'||batch_no as path, batch_no%10 in (3,5,8) as bad from (select distinct event_id//10 as batch_no from events) b""",
)
def quarantine_batches(spark, folder):
    good, bad = quarantine(ingest_bodies(spark, folder))
    return good.select("path", F.lit(False).alias("bad")).unionByName(
        bad.select("path", F.lit(True).alias("bad"))
    )


def device_events(spark: SparkSession, folder: str) -> DataFrame:
    raw = derived(spark, folder, "log_events")
    fields = F.concat(F.lit('{"retention_days_snapshot": '), "retention_token", F.lit(', "k": 1}'))
    return conform_events(raw.withColumn("fields", fields))


_TIER = """case when source='device-runtime' and retention_token='7' then '7d'
 when source='device-runtime' and retention_token='30' then '30d' end"""
_LABEL_KEY = """'env|'||env||'|host|'||host||'|level|'||level
 ||case when tier is null then '' else '|retention_policy|product-grant-v1|retention_tier|'||tier end
 ||'|service|'||service||case when stream='' then '' else '|stream|'||stream end||'|unit|'||unit"""


@query(
    "retention_tiers",
    f"""select arrival, tier as retention_tier, case when tier is not null then 'product-grant-v1' end as retention_policy
from (select *, {_TIER} as tier from log_events) e""",
    ("log_events",),
)
def retention_tiers(spark, folder):
    tier = retention_tier(F.col("source"), F.col("fields"))
    return device_events(spark, folder).select("arrival", tier.alias("retention_tier")).withColumn(
        "retention_policy", retention_policy(F.col("retention_tier"))
    )


@query(
    "label_sets",
    f"""select arrival, {_LABEL_KEY} as label_key from (select *, {_TIER} as tier from log_events) e""",
    ("log_events",),
)
def label_sets(spark, folder):
    tier = retention_tier(F.col("source"), F.col("fields"))
    labelled = device_events(spark, folder).withColumn("tier", tier)
    return labelled.select(
        "arrival", F.translate(label_key(F.col("tier")), "\0", "|").alias("label_key")
    )


@query(
    "label_maps",
    f"""select arrival, {_LABEL_KEY} as labels from (select *, {_TIER} as tier from log_events) e""",
    ("log_events",),
)
def label_maps(spark, folder):
    """The label map of each event, its entries in byte order of their names."""
    tier = retention_tier(F.col("source"), F.col("fields"))
    labels = F.array_sort(F.map_entries(label_set(tier)))
    pairs = F.transform(labels, lambda e: F.concat_ws("|", e["key"], e["value"]))
    return device_events(spark, folder).select("arrival", F.array_join(pairs, "|").alias("labels"))


@query(
    "push_times",
    f"""
with labelled as (select arrival, {_LABEL_KEY} as label_key, epoch_us(date_trunc('hour',ts))*1000 as t
  from (select *, {_TIER} as tier from log_events) e),
ranked as (select *, row_number() over (partition by label_key order by arrival) as rn from labelled)
select arrival, cast(rn + max(t-rn) over (partition by label_key order by arrival) as bigint) as push_nanos from ranked""",
    ("log_events",),
)
def push_times(spark, folder):
    """Event times are cut to the hour, so most events of a label set tie and must be moved."""
    events = device_events(spark, folder).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return label_events(events, block=4096).select("arrival", "push_nanos")


@query(
    "route_events",
    """select arrival, r.usage_role, case
 when not usage_role and (source='billing_usage' or stream='billing_usage') then 'billing usage token required'
 when usage_role and (source='billing_usage') <> (stream='billing_usage') then 'billing usage token required'
 when usage_role and source<>'billing_usage' then 'billing credential cannot write operational logs' end as reason
from log_events, (values (true),(false)) r(usage_role)""",
    ("log_events",),
)
def route_events(spark, folder):
    events = log_events(spark, folder)
    return events.select(
        "arrival", F.lit(True).alias("usage_role"), route_reason(True).alias("reason")
    ).unionByName(
        events.select(
            "arrival", F.lit(False).alias("usage_role"), route_reason(False).alias("reason")
        )
    )


_WITH_REPLAYS = """all_events as (select arrival, event_id, msg, source, stream from log_events union all
 select arrival+1000000000, event_id, msg, source, stream from log_events where unit='purchase.service'),
known as (select event_id from log_events where unit='signup.service')"""


def with_replays(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = log_events(spark, folder)
    replays = events.where(F.col("unit") == "purchase.service").withColumn(
        "arrival", F.col("arrival") + 1000000000
    )
    known = events.where(F.col("unit") == "signup.service").select("event_id")
    return events.unionByName(replays), known


@query(
    "ingest_results",
    f"""
with {_WITH_REPLAYS},
checked as (select *, case when source='billing_usage' then 'billing usage token required' when trim(msg)='' then 'msg is required' end as error from all_events),
firsts as (select event_id, min(arrival) as first_arrival from checked where error is null group by 1)
select arrival, c.event_id, case when error is not null then 'rejected'
 when arrival=first_arrival and c.event_id not in (select event_id from known) then 'accepted' else 'duplicate' end as status, error
from checked c left join firsts f on c.event_id=f.event_id""",
    ("log_events",),
)
def ingest_results(spark, folder):
    events, known = with_replays(spark, folder)
    return ingest_events(events, known).results


@query(
    "append_unique",
    f"""
with {_WITH_REPLAYS}
select event_id, arrival from all_events where event_id not in (select event_id from known)
qualify row_number() over (partition by event_id order by arrival)=1""",
    ("log_events",),
)
def append_unique_query(spark, folder):
    events, known = with_replays(spark, folder)
    return append_unique(events, known).select("event_id", "arrival")


@query(
    "redact_fields",
    """select event_id, case event_type
 when 'error' then '{"access-token":"[REDACTED]","k":'||event_id||',"note":"fine"}'
 when 'view' then '{"a":{"b":["[REDACTED]",1.50,{"Client_Secret":"[REDACTED]"}]},"z":true}'
 else props end as fields from events""",
)
def redact_fields_query(spark, folder):
    e = base(spark, folder, "events")
    raw = (
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit('{"k": '), "event_id", F.lit(', "access-token": "t", "note": "fine"}')),
        )
        .when(
            F.col("event_type") == "view",
            F.lit('{"z":true,"a":{"b":["Be\\u0061rer x",1.50,{"Client_Secret":{"deep":1}}]}}'),
        )
        .otherwise(F.col("props"))
    )
    return e.select("event_id", redact_fields(raw).alias("fields"))
