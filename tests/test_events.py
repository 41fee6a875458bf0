"""Log events: parsing, redaction, paths, levels, labels, queries."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallylog.functions.canonical import canonical_json
from tallylog.functions.labels import label_set, retention_tier
from tallylog.functions.levels import normalize_level
from tallylog.functions.paths import remote_host, sanitize_path
from tallylog.functions.redact import redact_event, redact_fields
from tallylog.functions.text import first_non_empty, is_blank, json_document, trim
from tallylog.functions.times import format_rfc3339, parse_rfc3339, rfc3339_sub
from tallylog.operators.query import EventQuery, QueryError, query_events
from tallylog.plans.ingest import ingest_events
from tallylog.schema import conform_events
from tallylog.sources.batches import batch_events, check_batches
from tallylog.sources.containers import ContainerConfig, parse_container
from tallylog.sources.journal import JournalConfig, initial_window, parse_journal, split_rejected


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def journal(spark, *documents, config=JournalConfig("fallback", "dev", "dev")):
    lines = [(d if isinstance(d, str) else json.dumps(d), i) for i, d in enumerate(documents)]
    parsed = parse_journal(spark.createDataFrame(lines, "line string, arrival bigint"), config)
    return [r.asDict() for r in parsed.orderBy("arrival").collect()]


BASE = {
    "__CURSOR": "s=abc", "_BOOT_ID": "boot-a", "_HOSTNAME": "host-a",
    "_SYSTEMD_UNIT": "svc.service", "PRIORITY": "6", "__REALTIME_TIMESTAMP": "1780297323000000",
}


def test_journal_plain_and_fallback_keys(spark):
    upper = {"SERVICE": "svc", "ENV": "staging", "VERSION": "v1", "TRACE_ID": "trace-1",
             "DEVICE_ID": "d-1"}
    plain, inner = journal(
        spark, {**BASE, **upper, "MESSAGE": "started"},
        {**BASE, **upper, "MESSAGE": '{"msg":"handled"}'},
    )
    assert plain["cursor"] == "s=abc" and plain["level"] == "info" and plain["msg"] == "started"
    assert plain["service"] == "svc" and plain["trace_id"] == "trace-1"
    assert plain["ts"] == datetime(2026, 6, 1, 7, 2, 3) and plain["fields"] is None
    assert inner["msg"] == "handled" and inner["device_id"] == "d-1"
    assert plain["reject_reason"] is None and len(plain["event_id"]) == 64


def test_journal_promotes_json_message(spark):
    message = {"level": "info", "msg": "issued", "service": "issuer", "status_code": 200,
               "Level": "x", "ts": "ignored", "status": 200, "duration_ms": 3.4, "path": "/v1/a",
               "trace_id": 3.7, "org_id": True}
    (event,) = journal(spark, {**BASE, "MESSAGE": json.dumps(message), "ORG_ID": "o"})
    assert (event["service"], event["status_code"], event["trace_id"]) == ("issuer", "200", "3")
    assert event["org_id"] == "o" and event["env"] == "dev"
    assert json.loads(event["fields"]) == {
        "ts": "ignored", "status": 200, "duration_ms": 3.4, "path": "/v1/a"
    }


def test_journal_redacts_and_rejects(spark):
    secret = {"msg": "issued private key", "access_token": "raw", "safe": "ok"}
    rows = journal(
        spark, {**BASE, "MESSAGE": json.dumps(secret)}, "not json", json.dumps(BASE) + "{}",
        {**BASE, "MESSAGE": [1, 2]}, "[1]",
    )
    assert rows[0]["msg"] == "[REDACTED]"
    assert json.loads(rows[0]["fields"]) == {"access_token": "[REDACTED]", "safe": "ok"}
    assert rows[1]["reject_reason"] and rows[2]["reject_reason"] and rows[4]["reject_reason"]
    assert rows[3]["msg"] == "journal event" and rows[3]["reject_reason"] is None


def test_container_lines(spark):
    config = ContainerConfig("broker", service="emqx", env="staging", version="1", host="h",
                             unit="u", source="emqx", component="mqtt")
    lines = [
        "2026-06-03T01:02:03.123456789Z [debug] clientid=a action=publish topic=$vc/x",
        "2026-06-03T01:02:03Z [debug] password=secret token=abc",
        "no time here",
        "single",
    ]
    df = spark.createDataFrame(list(zip(lines, range(4))), "line string, arrival bigint")
    rows = parse_container(df, config).orderBy("arrival").collect()
    assert rows[0].cursor == "2026-06-03T01:02:03.123456789Z" and rows[0].ts_sub == 789
    assert rows[0].level == "debug" and rows[0].msg == "emqx broker mqtt trace"
    assert "action=publish" in json.loads(rows[0].fields)["log_line"]
    assert json.loads(rows[1].fields)["log_line"] == "[REDACTED]" and rows[1].level == "info"
    assert json.loads(rows[2].fields)["log_line"] == "time here"
    assert json.loads(rows[3].fields)["log_line"] == "single"
    assert rows[2].event_id != rows[3].event_id


@pytest.mark.parametrize(
    "target, expected",
    [
        ("/v1/devices", "/v1/devices"),
        ("/v1/callback?token=abc&state=ok", "/v1/callback?state=ok&token=[REDACTED]"),
        ("/v1/callback?Access_Token=abc&refresh_token=def&state=ok",
         "/v1/callback?Access_Token=[REDACTED]&refresh_token=[REDACTED]&state=ok"),
        ("/v1/callback?api_key=a&apikey=b&password=c&client_secret=d&visible=value",
         "/v1/callback?api_key=[REDACTED]&apikey=[REDACTED]&client_secret=[REDACTED]"
         "&password=[REDACTED]&visible=value"),
        ("/v1/callback?token=a&token=b", "/v1/callback?token=[REDACTED]&token=[REDACTED]"),
        ("/a b?x=~*+y&x=1&b", "/a%20b?b=&x=~%2A+y&x=1"),
        ("relative?token=x", "relative?token=[REDACTED]"),
        ("/a%zz?token=q", "/a%zz?token=[REDACTED]"),
    ],
)
def test_sanitize_path(spark, target, expected):
    assert column(spark, [target], sanitize_path) == [expected]


def test_small_functions(spark):
    assert column(spark, ["1.2.3.4:80", "[::1]:80", "::1", "host", ":80"], remote_host) == [
        "1.2.3.4", "::1", "::1", "host", ""]
    levels = ["", "INFO", "debug", "warning", " warn", "error", "dpanic", "panic", "fatal", "x"]
    assert column(spark, levels, normalize_level) == [
        "info", "info", "debug", "warn", "warn", "error", "dpanic", "panic", "fatal", "info"]
    odd = ["\u2003 a \u00a0b\u0085\n", "\t\u3000", None]
    assert column(spark, odd, trim) == ["a \u00a0b", "", None]
    assert column(spark, odd, is_blank) == [False, True, True]
    assert column(spark, [" ", None], lambda v: first_non_empty(v, F.lit(" z "))) == ["z", "z"]
    times = ["2026-06-03T01:02:03.1234567Z", "2026-06-03T01:02:03+02:00", "2026-02-30T00:00:00Z", "x"]
    shown = column(spark, times, lambda v: format_rfc3339(parse_rfc3339(v), rfc3339_sub(v)))
    assert shown == ["2026-06-03T01:02:03.1234567Z", "2026-06-02T23:02:03Z", None, None]


def test_json_text(spark):
    odd = 'a"\\u000B\x0b\x1f<&>\u2028é\x7f\b'
    out = column(spark, [odd], lambda v: json_document({"v": v}))[0]
    assert out == (
        '{"v":"a\\"\\\\u000B\\u000b\\u001f\\u003c\\u0026\\u003e\\u2028é\x7f\\b"}')
    assert json.loads(out)["v"] == odd
    texts = ['{"b":1.0,"a":1e2,"c":[9007199254740993,"<"]}', '{"z":1,"a":{"y":2,"x":"é"}}', "{", None]
    assert column(spark, texts, canonical_json) == [
        '{"a":1e2,"b":1.0,"c":[9007199254740993,"\\u003c"]}',
        '{"a":{"x":"é","y":2},"z":1}', None, None]


def test_redaction_at_any_depth(spark):
    fields = {"items": [{"client_secret": "raw", "safe": "ok"}, "Bearer raw"],
              "nested": {"values": [{"password": "raw"}]}, "n": 7}
    texts = [json.dumps(fields), '{"x":"\\u0070assword"}', '{"k": 1}', None]
    out = column(spark, texts, redact_fields)
    assert json.loads(out[0]) == {
        "items": [{"client_secret": "[REDACTED]", "safe": "ok"}, "[REDACTED]"],
        "nested": {"values": [{"password": "[REDACTED]"}]}, "n": 7}
    assert json.loads(out[1]) == {"x": "[REDACTED]"} and out[2:] == ['{"k": 1}', None]


def test_retention_tier(spark):
    values = ["7", "30", "90", "0", "15", '"7"', "7.0", "null"]
    texts = [f'{{"retention_days_snapshot":{v}}}' for v in values] + ["{}", None]
    tier = lambda v: retention_tier(F.lit("device-runtime"), v)
    assert column(spark, texts, tier) == ["7d", "30d", "90d"] + [None] * 7
    assert column(spark, texts[:1], lambda v: retention_tier(F.lit("journald"), v)) == [None]
    event = {"event_id": "e", "env": "p", "service": "s", "host": "h", "unit": "u", "level": "info"}
    row = conform_events(spark.createDataFrame([event])).select(
        label_set(F.lit("7d")).alias("m")).first().m
    assert row == {"env": "p", "service": "s", "host": "h", "unit": "u", "level": "info",
                   "retention_tier": "7d", "retention_policy": "product-grant-v1"}


def events(spark, *rows):
    base = {"level": "info", "msg": "m", "service": "s", "env": "staging", "version": "v",
            "host": "h", "unit": "u", "source": "journald", "fields": None, "stream": None}
    full = [{**base, "arrival": i, **r} for i, r in enumerate(rows)]
    schema = ", ".join(
        f"{k} {'bigint' if k == 'arrival' else 'timestamp_ntz' if k == 'ts' else 'smallint' if k == 'ts_sub' else 'string'}"
        for k in {k: 0 for r in full for k in r})
    names = [c.strip().split()[0] for c in schema.split(",")]
    return conform_events(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))


def test_query_order_limit_and_nanoseconds(spark):
    df = events(
        spark, {"event_id": "old", "ts": datetime(2026, 1, 1, 1), "ts_sub": 0},
        {"event_id": "mid", "ts": datetime(2026, 1, 1, 2), "ts_sub": 5},
        {"event_id": "mid", "ts": datetime(2026, 1, 1, 4), "ts_sub": 0},
        {"event_id": "new", "ts": datetime(2026, 1, 1, 3), "ts_sub": 0},
        {"event_id": "use", "ts": datetime(2026, 1, 1, 3), "ts_sub": 0, "stream": "billing_usage"},
    )
    ids = lambda q: [r.event_id for r in query_events(df, q).collect()]
    assert ids(EventQuery(limit=2)) == ["new", "mid"]
    assert ids(EventQuery(limit=2, order="asc")) == ["old", "mid"]
    assert ids(EventQuery(until="2026-01-01T02:00:00.000000004Z")) == ["old"]
    assert ids(EventQuery(since="2026-01-01T02:00:00.000000005Z", until="2026-01-01T02:30:00Z")) == ["mid"]


@pytest.mark.parametrize("params", [
    {"since": "not-a-time"}, {"until": "not-a-time"}, {"limit": "0"}, {"limit": "1001"},
    {"limit": "abc"}, {"order": "sideways"}, {"stream": "billing_usage"}])
def test_query_bounds(params):
    with pytest.raises(QueryError):
        EventQuery.from_params(params)


def test_ingest_statuses(spark):
    t = datetime(2026, 1, 1)
    df = events(
        spark, {"event_id": "a", "ts": t, "msg": " "}, {"event_id": "a", "ts": t},
        {"event_id": "a", "ts": t}, {"event_id": "b", "ts": t}, {"event_id": "c", "ts": None},
        {"event_id": "u", "ts": t, "source": "billing_usage"},
    )
    known = spark.createDataFrame([("b",)], "event_id string")
    out = ingest_events(df, known)
    got = {r.arrival: (r.status, r.error) for r in out.results.collect()}
    assert got == {
        0: ("rejected", "msg is required"), 1: ("accepted", None), 2: ("duplicate", None),
        3: ("duplicate", None), 4: ("rejected", "ts is required"),
        5: ("rejected", "billing usage token required")}
    assert [r.arrival for r in out.accepted.collect()] == [1]


def test_batches_keep_number_text(spark):
    event = ('{"event_id":"e","ts":"2026-01-01T00:00:00.000000001Z","level":"info","fields":'
             '{"q":1.50,"n":9007199254740993}}')
    bodies = ['{"events":[%s]}' % event, '{"events":[{"event_id":5}]}', '{"events":[]}{}', "{",
              '{"events":[{},{}]}', "x" * 300, '{"other":1}', '{"events":[null]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "n bigint, body string")
    checked = check_batches(df, max_bytes=290, max_events=1)
    got = [r.batch_error for r in checked.orderBy("n").collect()]
    assert got == [None, "invalid json", "invalid trailing json", "invalid json",
                   "too many events", "request body too large", None, None]
    row = batch_events(checked, "n").where("event_id='e'").first()
    assert row.fields == '{"n":9007199254740993,"q":1.50}' and row.ts_sub == 1


def test_initial_window(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, h),) for h in range(3)], "ts timestamp_ntz")
    assert initial_window(df, "90m", "2026-01-01 02:00:00").count() == 2
    assert initial_window(df, "2026-01-01T01:30:00Z", "2026-01-01 02:00:00").count() == 1
    assert initial_window(df, "", "2026-01-01 02:00:00").count() == 3
    good, bad = split_rejected(df.withColumn("reject_reason", F.lit(None).cast("string")))
    assert good.count() == 3 and bad.count() == 0


def test_redact_event_keeps_other_columns(spark):
    df = events(spark, {"event_id": "token-1", "ts": datetime(2026, 1, 1), "msg": "Token x"})
    row = redact_event(df).first()
    assert row.event_id == "token-1" and row.msg == "[REDACTED]"
