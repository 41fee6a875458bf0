"""Derived tables: one SQL text each, valid in Spark and in DuckDB.

``{sha:x}`` stands for the SHA-256 hex digest of x, which the two engines spell differently. Every
table is a projection or aggregation of a whole driver table, so it grows with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    # 10 000 rows at sf0.01; some blank messages, some usage rows.
    "log_events": """
select {sha:'host-'||(user_id%7)||chr(0)||'boot-'||(user_id%3)||chr(0)||event_type||'.service'||chr(0)||'s='||event_id} as event_id,
 ts, event_id as arrival,
 case event_type when 'error' then 'error' when 'signup' then 'warn' when 'view' then 'debug' else 'info' end as level,
 case when event_id%97=0 then 'issued access Token' when event_id%89=0 then '  ' else event_type||' handled' end as msg,
 event_type||'-api' as service,
 case when user_id%3=0 then 'prod' when user_id%3=1 then 'staging' else 'dev' end as env,
 'v'||(user_id%4) as version, 'host-'||(user_id%7) as host, event_type||'.service' as unit,
 case when event_id%11=0 then 'billing_usage' when event_id%5=0 then 'device-runtime' else 'journald' end as source,
 case when event_id%11=0 then 'billing_usage' when event_id%13=0 then 'operational' else '' end as stream,
 'req-'||event_id as request_id, 'device-'||user_id as device_id, 'org-'||(user_id%10) as org_id,
 case when event_type='error' then '500' else '200' end as status_code,
 case when event_type='error' then '5xx' else '2xx' end as status_class,
 case when event_type='error' then 'failure' else 'success' end as outcome,
 case event_id%4 when 0 then '7' when 1 then '30' when 2 then '"90"' else '15' end as retention_token,
 props as fields
from events""",
    # Replays with the same content and, some of them, with another environment.
    "arrivals": """
select cast(event_id as string) as event_id, ts, event_id as arrival, event_type, user_id, 'staging' as env from events
union all
select cast(event_id as string), ts, event_id+1000000000, event_type, user_id,
 case when event_id%100=0 then 'other' else 'staging' end
from events where event_type='purchase'""",
    # Usage per user, event type and day; quantities are integers.
    "usage": """
select user_id, cast(date_trunc('day',ts) as date) as window_day, event_type, count(*) as c,
 cast(sum(cast(round(value*100) as bigint)) as bigint) as b
from events group by 1,2,3""",
    # Dense receipts 1..N.
    "receipts": """
select event_id+1 as sequence, cast(event_id as string) as event_id, 'env-'||(user_id%2) as env,
 {sha:cast(event_id as string)||chr(0)||event_type} as content_sha256,
 ts as received_at, event_type||':'||props as body, {sha:event_type||':'||props} as record_sha256
from events""",
    # Export sets: 700 receipts wide every 600; sets whose number ends in 9 are not verified yet.
    "catalog": """
select set_no, 'set-'||set_no as set_id, from_sequence, through_sequence,
 through_sequence-from_sequence+1 as record_count, through_sequence as high_water,
 case when set_no%10=9 then 'uploaded' else 'verified' end as status,
 last_ts as created_at, last_ts as verified_at, {sha:'bindings-'||set_no} as bindings_sha256,
 {sha:'manifest-'||set_no} as manifest_sha256
from (select event_id//600 as set_no, (event_id//600)*600+1 as from_sequence,
  (event_id//600)*600+700 as through_sequence, max(ts) as last_ts from events group by event_id//600) s""",
    # Decisions on blocks of 1000; every block whose number ends in 5 was aborted.
    "decisions": """
select 'op-'||op_no as operation_id, 'prod' as environment, '{store}' as store_id,
 op_no*1000+1 as from_sequence, op_no*1000+n as through_sequence, {sha:'plan-'||op_no} as plan_sha256,
 'set-'||((op_no*10)//6) as set_id, case when op_no%10=5 then 'aborted' when op_no%10=7 then 'pending' else 'completed' end as status,
 last_ts as last_ts, op_no
from (select event_id//1000 as op_no, count(*) as n, max(ts) as last_ts from events group by event_id//1000) s""",
    # Usage events as JSON text. By event type: no id (click), unknown metric (error), a metric
    # twice (signup), a window that is empty after truncation (view), valid (purchase).
    "usage_text": """
select user_id, window_day, event_type, c, b,
 '{"usage_id":"'||case when event_type='click' then '' else 'u-'||user_id||'-'||window_day||'-'||event_type end
 ||'","service_code":" mqtt ","brand_cloud_id":"brand-'||user_id||'","event_time":"'||window_day||'T23:59:59.123456789Z","window_start":"'
 ||window_day||'T00:00:00.5Z","window_end":"'||window_day||case when event_type='view' then 'T00:00:00.500000400Z' else 'T23:59:59Z' end
 ||'","meter_epoch":"epoch-1","sequence":'||user_id||',"source":"meter","measurements":[{"metric_code":"publish_count","unit":"requests","quantity":'||c
 ||'},{"metric_code":"'||case when event_type='error' then 'unknown' when event_type='signup' then 'publish_count' else 'publish_bytes' end
 ||'","unit":"'||case when event_type='signup' then 'requests' else 'bytes' end||'","quantity":'||b||'}]'
 ||case when event_type='purchase' then ',"dimensions":{"z":"1","region":"r<'||user_id||'"}' else '' end||'}' as usage_json
from (select user_id, cast(date_trunc('day',ts) as date) as window_day, event_type, count(*) as c,
  cast(sum(cast(round(value*100) as bigint)) as bigint) as b from events group by 1,2,3) u""",
    # Usage events as receipt input; ``copy`` 1 is a replay, with another environment for views.
    "receipt_events": """
select ((user_id*1000+day_no)*10+kind_no)*2+copy as arrival, 'u-'||user_id||'-'||window_day||'-'||event_type as event_id,
 cast(window_day as timestamp) as ts, 'info' as level, 'usage' as msg, 'meter' as service,
 case when copy=1 and event_type='view' then 'other' else 'prod' end as env, 'v'||copy as version, 'h1' as host, 'u1' as unit,
 case when event_type='error' then 'journald' else 'billing_usage' end as source, 'billing_usage' as stream, event_type, copy,
 case when event_type='click' and copy=0 then '{"other":1}' when event_type='click' then '{"usage_event":{"token":'||c||'}}'
  else '{"usage_event":{"b":'||b||',"a":'||c||'}}' end as fields
from (select user_id, cast(date_trunc('day',ts) as date) as window_day, day(min(ts)) as day_no, event_type,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as kind_no,
  count(*) as c, cast(sum(cast(round(value*100) as bigint)) as bigint) as b, {array:0,1} as copies from events
  group by user_id, cast(date_trunc('day',ts) as date), event_type) u, {unnest:copies}""",
    "change_log": """
select o_orderkey+1 as generation, 'ids' as bucket, 'cust-'||o_custkey as key,
 case when o_orderstatus='F' then 'delete' else 'put' end as kind, o_orderpriority as value
from orders""",
    "snapshot": """
select 'ids' as bucket, 'cust-'||c_custkey as key, c_mktsegment as value from customer""",
    "backlog": """
select 'q/'||lpad(cast(doc_id as string),12,'0')||'.json' as path, n_chars as size from documents""",
    "access": """
select page_id, 'GET' as method, case when page_id%7=0 then 404 else null end as status,
 page_id*1500 as micros, case when page_id%3=0 then '[2001:db8::'||page_id||']:443' when page_id%3=1 then '10.0.0.'||(page_id%250)||':8080' else 'unix' end as address,
 case when page_id%2=0 then ' req-'||page_id||' ' else '  ' end as request_id,
 case when instr(url,'?')>0 then '/p/'||page_id||'?state=ok&token=t'||page_id||'&Api_Key=k&page=2' else '/p/'||page_id end as target
from pages""",
}

#: Store identity used where a table needs one.
STORE = "ab" * 16


def table_sql(name: str, engine: str) -> str:
    """SQL text of a derived table for ``spark`` or ``duckdb``."""
    text = TABLES[name].replace("{store}", STORE)
    digest = (lambda x: f"sha2({x},256)") if engine == "spark" else (lambda x: f"sha256({x})")
    text = _digests(text, digest)
    if engine == "spark":
        text = re.sub(r"\{array:([^}]*)\}", r"array(\1)", text)
        text = re.sub(r", \{unnest:(\w+)\}", r" lateral view explode(\1) x as copy", text)
        text = text.replace("as timestamp)", "as timestamp_ntz)")
    else:
        text = re.sub(r"\{array:([^}]*)\}", r"[\1]", text)
        text = re.sub(r"\{unnest:(\w+)\}", r"unnest(u.\1) x(copy)", text)
    if engine == "spark":
        text = re.sub(r"(\([^()]*\)|\w+)//(\d+)", r"(\1 div \2)", text)
    return text.strip()


def _digests(text: str, digest) -> str:
    out, at = [], 0
    while (start := text.find("{sha:", at)) >= 0:
        end = text.index("}", start)
        out += [text[at:start], digest(text[start + 5 : end])]
        at = end + 1
    return "".join([*out, text[at:]])


def base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of one small file; an input with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table; Spark prunes it to the columns a query uses."""
    source = next(
        t for t in ("events", "orders", "customer", "documents", "pages")
        if re.search(rf"\bfrom {t}\b", TABLES[name])
    )
    view = f"{source}_in"
    # Braces of JSON literals are doubled, since named DataFrames are given in braces.
    text = table_sql(name, "spark").replace("{", "{{").replace("}", "}}")
    text = re.sub(rf"\bfrom {source}\b", f"from {{{view}}}", text)
    return spark.sql(text, **{view: base(spark, folder, source)})
