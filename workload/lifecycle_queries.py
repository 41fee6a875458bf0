"""Queries over the receipt lifecycle: coverage, retirement, cache, audits, change logs, backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.operators.scan import covered_prefix
from tallylog.plans.audit import (
    StoreState, audit_snapshot, audit_store, compare_states, compare_stores, index_violations,
    recovery_state, tiling_violations,
)
from tallylog.plans.changes import apply_change_log, change_log_violations
from tallylog.plans.lifecycle import (
    backfill_bindings, backfill_progress, cache_bytes, check_rehydration, eligible_receipts,
    evict_cache, match_authority, plan_retirement, promote_catalog, protection_status,
    rehydrate_cache, resolve_operations, retire, seal,
)
from tallylog.sources.backlog import backlog_over_cap, backlog_stats, replay_order
from workload.receipt_queries import head_of, receipts, split_store
from workload.registry import query
from workload.tables import STORE, derived

NOW = "2024-04-25 12:00:00"  # 90 days earlier is 2024-01-26 12:00:00


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "catalog")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    return catalog(spark, folder).where(F.col("status") == "verified")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions on 1000 receipts each; terminal ones are sealed, but one in ten with a wrong seal."""
    rows = derived(spark, folder, "decisions").withColumns(
        {
            "completed_at": F.when(F.col("status") != "pending", F.col("last_ts")),
            "retired_through": F.when(F.col("status") == "completed", F.col("through_sequence"))
            .otherwise(F.col("from_sequence") - 1),
        }
    )
    sealed = F.when(F.col("status") == "pending", F.lit("")).when(
        F.col("op_no") % 10 == 3, F.sha2(F.lit("wrong"), 256)
    ).otherwise(seal())
    return rows.withColumn("receipt_sha256", sealed).drop("last_ts")


@query(
    "covered_prefix",
    """with v as (select from_sequence, through_sequence from catalog where status='verified'),
w as (select *, coalesce(max(through_sequence) over (order by from_sequence rows between unbounded preceding and 1 preceding),0) as reach from v)
select coalesce(min(case when from_sequence>reach+1 then reach end), max(through_sequence)) as covered from w""",
    ("catalog",),
)
def covered_prefix_query(spark, folder):
    return covered_prefix(verified(spark, folder), "from_sequence", "through_sequence")


@query(
    "decision_tiling",
    """with c as (select *, coalesce(lag(through_sequence) over (order by from_sequence),0) as before from decisions where status='completed'),
f as (select max(sequence)//2 as floor from receipts)
select 'decision_tiling' as rule, cast(from_sequence as varchar) as detail from c where from_sequence<>before+1
union all select 'decision_floor', cast(t as varchar) from (select max(through_sequence) as t from c), f where t<>floor""",
    ("decisions", "receipts"),
)
def decision_tiling(spark, folder):
    return tiling_violations(decisions(spark, folder), head_of(spark, folder) // 2)


_ELIGIBLE = """b as (select (select max(sequence)//10 from receipts) as floor, (select max(sequence) from receipts) as head),
e as (select sequence, received_at<=timestamp '2024-01-26 12:00:00' and exists(select 1 from catalog where status='verified' and sequence between from_sequence and through_sequence) as eligible
  from receipts, b where sequence>floor),
p as (select coalesce(min(case when not eligible then sequence end), max(head)+1)-1 as last from e, b)"""


def retirement_input(spark: SparkSession, folder: str):
    """(receipts above a floor of a tenth of the store, bindings, verified sets, floor, head)."""
    head = head_of(spark, folder)
    floor = head // 10
    rows = receipts(spark, folder).where(F.col("sequence") > floor)
    return rows, rows, verified(spark, folder), floor, head


@query(
    "retirement_eligible",
    f"with {_ELIGIBLE} select sequence, eligible from e",
    ("receipts", "catalog"),
)
def retirement_eligible(spark, folder):
    rows, bindings, sets, _, _ = retirement_input(spark, folder)
    return eligible_receipts(rows, bindings, sets, NOW)


@query(
    "retirement_legacy",
    """select sequence, sequence%3=0 and timestamp '2024-01-20 00:00:00'<=timestamp '2024-01-26 12:00:00'
  or sequence%3<>0 and received_at<=timestamp '2024-01-26 12:00:00' as eligible from receipts""",
    ("receipts",),
)
def retirement_legacy(spark, folder):
    """Every third receipt is an old one without a time and ages from the end of the backfill."""
    rows = receipts(spark, folder)
    old = F.col("sequence") % 3 == 0
    bindings = rows.withColumns(
        {"is_legacy": old, "received_at": F.when(~old, F.col("received_at"))})
    whole = rows.agg(
        F.lit("set-0").alias("set_id"), F.min("sequence").alias("from_sequence"),
        F.max("sequence").alias("through_sequence"))
    return eligible_receipts(rows, bindings, whole, NOW, "2024-01-20 00:00:00")


# The rule walks: a stretch starts at the floor + 1, is in the verified set that reaches furthest from
# there, and the next one starts where it ends; stretches are cut into ranges of at most 1000.
_PLANNED = f"""{_ELIGIBLE},
walk as (
 select 0 as step, cast(null as bigint) as f, b.floor as t, cast(null as varchar) as set_id from b
 union all
 select pick.step, pick.f, pick.t, pick.set_id from (
  select w.step+1 as step, w.t+1 as f, least(p.last, c.through_sequence) as t, c.set_id,
   row_number() over (partition by w.step order by c.through_sequence desc, c.set_id) as place
  from walk w, p, catalog c
  where w.t<p.last and c.status='verified' and w.t+1 between c.from_sequence and c.through_sequence) pick
 where pick.place=1),
planned as (select s as f, least(s+999, t) as t, set_id from (
 select unnest(generate_series(f, t, 1000)) as s, t, set_id from walk where f is not null) stretch)"""


@query(
    "retirement_plan",
    f"with recursive {_PLANNED} select f as from_sequence, t as through_sequence, set_id from planned",
    ("receipts", "catalog"),
)
def retirement_plan(spark, folder):
    rows, bindings, sets, floor, head = retirement_input(spark, folder)
    return plan_retirement(eligible_receipts(rows, bindings, sets, NOW), sets, floor, head)


def pending_plans(plans: DataFrame) -> DataFrame:
    """A pending decision per planned range; the third is missing, which breaks the chain."""
    third = plans.orderBy("from_sequence").offset(2).limit(1).select("from_sequence")
    return plans.join(third, "from_sequence", "left_anti").select(
        F.concat(F.lit("op-"), "from_sequence").alias("operation_id"),
        F.lit("prod").alias("environment"), F.lit(STORE).alias("store_id"),
        "from_sequence", "through_sequence",
        F.sha2(F.col("from_sequence").cast("string"), 256).alias("plan_sha256"), "set_id",
        F.lit("pending").alias("status"), F.lit("").alias("receipt_sha256"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        (F.col("from_sequence") - 1).alias("retired_through"),
    )


_PENDING = f"""{_PLANNED},
pend as (select f, t, set_id from planned qualify row_number() over (order by f)<>3),
linked as (select *, f-1=coalesce(lag(t) over (order by f),(select floor from b)) as ok from pend),
ran as (select * from linked where f<coalesce((select min(f) from linked where not ok), 9223372036854775807))"""


def applied(spark: SparkSession, folder: str):
    rows, bindings, sets, floor, head = retirement_input(spark, folder)
    eligible = eligible_receipts(rows, bindings, sets, NOW)
    pending = pending_plans(plan_retirement(eligible, sets, floor, head))
    authority = pending.withColumn("status", F.lit("ACTIVE"))
    return retire(rows, pending, authority, eligible, floor, "prod", STORE, NOW)


@query(
    "retirement_apply",
    f"""with recursive {_PENDING}
select 'op-'||f as operation_id, case when f in (select f from ran) then 'completed' else 'pending' end as status,
 case when f in (select f from ran) then t else f-1 end as retired_through,
 case when f in (select f from ran) then sha256('{{"operation_id":"op-'||f||'","environment":"prod","store_id":"{STORE}","from_sequence":"'||f||'","through_sequence":"'||t
  ||'","plan_sha256":"'||sha256(cast(f as varchar))||'","status":"completed","receipt_sha256":"","completed_at":"2024-04-25T12:00:00Z","retired_through":"'||t||'","set_id":"'||set_id||'"}}') else '' end as receipt_sha256
from pend""",
    ("receipts", "catalog"),
)
def retirement_apply(spark, folder):
    _, after = applied(spark, folder)
    return after.select("operation_id", "status", "retired_through", "receipt_sha256")


@query(
    "retirement_remaining",
    f"""with recursive {_PENDING} select sequence from receipts, b where sequence>floor and sequence>coalesce((select max(t) from ran), floor)""",
    ("receipts", "catalog"),
)
def retirement_remaining(spark, folder):
    remaining, _ = applied(spark, folder)
    return remaining.select("sequence")


def operation_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Per decision number: a replayed plan, a changed plan, an apply, an abort, an unknown abort."""
    d = derived(spark, folder, "decisions")
    which = F.col("op_no") % 5
    return d.select(
        F.when(which < 2, "plan").when(which == 2, "abort").when(which == 3, "apply")
        .otherwise("abort").alias("action"),
        F.when(which == 4, F.concat(F.lit("new-"), "op_no")).otherwise(F.col("operation_id"))
        .alias("operation_id"),
        "environment", "store_id", "from_sequence",
        (F.col("through_sequence") - F.when(which == 1, 1).otherwise(0)).alias("through_sequence"),
        "plan_sha256", "set_id",
    )


@query(
    "resolve_operations",
    f"""with r as (select *, op_no%5 as w from decisions)
select case when w<2 then 'plan' when w=3 then 'apply' else 'abort' end as action,
 case when w=4 then 'new-'||op_no else operation_id end as requested_id,
 case when w=0 then 'unchanged' when w=1 then 'conflict'
  when w=2 and status in ('completed','aborted') then 'unchanged' when w=2 then 'aborted'
  when w=3 and status='completed' then 'unchanged' when w=3 then 'conflict' else 'aborted' end as outcome,
 case when w=4 or (w=2 and status='pending') then 'aborted' else status end as status,
 case when w=4 then sha256('{{"operation_id":"new-'||op_no||'","environment":"prod","store_id":"{STORE}","from_sequence":"'||from_sequence||'","through_sequence":"'||through_sequence
  ||'","plan_sha256":"'||plan_sha256||'","status":"aborted","receipt_sha256":"","completed_at":"2024-04-25T12:00:00Z","retired_through":"0","set_id":"'||set_id||'"}}') end as new_seal
from r""",
    ("decisions",),
)
def resolve_operations_query(spark, folder):
    requests = operation_requests(spark, folder)
    authority = requests.withColumn("status", F.lit("ABORT_REQUESTED")).drop("action")
    out = resolve_operations(
        decisions(spark, folder), requests, authority, 0, head_of(spark, folder), "prod", STORE,
        NOW,
    )
    fresh = F.col("requested_id").startswith("new-")
    return out.select(
        "action", "requested_id", "outcome", "status",
        F.when(fresh, F.col("receipt_sha256")).alias("new_seal"),
    )


@query(
    "match_authority",
    "select operation_id, op_no%3<>1 and op_no%4<>2 as authority_ok from decisions",
    ("decisions",),
)
def match_authority_query(spark, folder):
    ours = decisions(spark, folder)
    theirs = ours.withColumns(
        {
            "status": F.when(F.col("op_no") % 3 == 1, "DRAFT").otherwise("ACTIVE"),
            "set_id": F.when(F.col("op_no") % 4 == 2, "other").otherwise(F.col("set_id")),
        }
    )
    return match_authority(ours, theirs, "ACTIVE").select("operation_id", "authority_ok")


@query(
    "promote_catalog",
    """select set_id, case when set_no%4=1 then 'conflict' when set_no%4=2 then 'unchanged' when set_no%4=3 then 'conflict' else 'promoted' end as outcome from catalog""",
    ("catalog",),
)
def promote_catalog_query(spark, folder):
    """By set number: a first promotion, a changed value, a repeated one, one not uploaded yet."""
    sets = catalog(spark, folder)
    kind = F.col("set_no") % 4
    captures = sets.withColumn("status", F.when(kind == 3, "sealed").otherwise("uploaded"))
    changed = sets.withColumn(
        "record_count", F.col("record_count") + F.when(kind == 1, 1).otherwise(0)
    )
    return promote_catalog(captures, changed, sets.where(kind == 2), NOW).select(
        "set_id", "outcome"
    )


@query(
    "rehydrate_check",
    """with b as (select max(sequence)//2 as floor from receipts),
x as (select sequence, body, floor, (sequence-1)//600 as set_no from receipts, b where body not like 'signup:%'),
y as (select *, lag(sequence) over (partition by set_no order by sequence) as before from x)
select 'set-'||set_no as set_id, sequence, case when set_no%10=9 then 'not_in_set' when sequence>floor then 'above_floor' when body like 'view:%' then 'binding' when body like 'error:%' then 'time'
 when before<>sequence-1 then 'not_contiguous' end as reason from y""",
    ("receipts",),
)
def rehydrate_check(spark, folder):
    """All records in sets of 600, with changed views, shifted errors and missing signups."""
    rows = receipts(spark, folder)
    exports = rows.where(~F.col("body").startswith("signup:")).select(
        F.concat(F.lit("set-"), F.expr("(sequence-1) div 600")).alias("set_id"),
        "sequence", "content_sha256",
        F.when(F.col("body").startswith("error:"), F.col("received_at") + F.expr("interval 1 day"))
        .otherwise(F.col("received_at")).alias("received_at"),
        F.when(F.col("body").startswith("view:"), F.upper("body")).otherwise(F.col("body"))
        .alias("record"),
    )
    checked = check_rehydration(
        exports, catalog(spark, folder), rows, head_of(spark, folder) // 2
    )
    return checked.select("set_id", "sequence", "reason")


@query(
    "rehydrate_cache",
    """with b as (select max(sequence)//2 as floor from receipts)
select sequence, length(body) as bytes, sequence%5=0 as was_cached from receipts, b where sequence<=floor""",
    ("receipts",),
)
def rehydrate_cache_query(spark, folder):
    """One set that holds every retired record, installed over a cache with some of them, changed."""
    floor = head_of(spark, folder) // 2
    rows = receipts(spark, folder)
    retired = rows.where(F.col("sequence") <= floor)
    exports = retired.select(
        F.lit("set-all").alias("set_id"), "sequence", "content_sha256", "received_at",
        F.col("body").alias("record"))
    whole = spark.createDataFrame(
        [("set-all", 1, floor, "verified")],
        "set_id string, from_sequence bigint, through_sequence bigint, status string")
    cache = retired.where(F.col("sequence") % 5 == 0).select(
        "sequence", F.concat("body", F.lit("!")).alias("body"))
    checked = check_rehydration(exports, whole, rows, floor)
    budget = retired.agg(F.sum(F.octet_length("body"))).first()[0]
    held = cache.select("sequence", F.lit(True).alias("_held"))
    return rehydrate_cache(checked, cache, budget).join(held, "sequence", "left").select(
        "sequence", F.octet_length("body").cast("bigint").alias("bytes"),
        F.coalesce("_held", F.lit(False)).alias("was_cached"))


_CACHE = """cache as (select sequence, case when body like 'view:%' then body||'!' else body end as body from receipts
  where sequence<=(select max(sequence)//2 from receipts) and body not like 'error:%')"""


@query(
    "cache_evict",
    f"""with {_CACHE}, bound as (select max(sequence)//3 as t from receipts)
select sequence, row_number() over (order by sequence)>1000 or sequence>t as kept from cache, bound""",
    ("receipts",),
)
def cache_evict(spark, folder):
    _, _, cache, _ = split_store(spark, folder)
    evicted, remaining = evict_cache(cache, head_of(spark, folder) // 3)
    return evicted.select("sequence", F.lit(False).alias("kept")).unionByName(
        remaining.select("sequence", F.lit(True).alias("kept"))
    )


@query(
    "cache_bytes",
    f"with {_CACHE} select cast(sum(length(body)) as bigint) as cache_bytes from cache",
    ("receipts",),
)
def cache_bytes_query(spark, folder):
    _, _, cache, _ = split_store(spark, folder)
    return cache_bytes(cache)


@query(
    "protection_status",
    """with t as (select max(verified_at) as last_verified, max(high_water) as protected_high_water, max(created_at) as last_protected_at from catalog
  where status='verified')
select (select max(sequence) from receipts) as high_water, cast(0 as bigint) as retired_through, last_verified, last_protected_at, protected_high_water,
 (select received_at from receipts where sequence=protected_high_water+1) as earliest_unprotected_at, true as protection_overdue from t""",
    ("receipts", "catalog"),
)
def protection_status_query(spark, folder):
    head = head_of(spark, folder)
    return protection_status(verified(spark, folder), receipts(spark, folder), head, 0, NOW)


@query(
    "backfill_bindings",
    """with b as (select max(sequence) as head from receipts)
select event_id, sequence, content_sha256, record_sha256, true as is_legacy from receipts, b
where sequence>head//4 and sequence<=head//2 and body not like 'click:%'""",
    ("receipts",),
)
def backfill_bindings_query(spark, folder):
    """Old receipts of the second quarter; those of clicks have their bindings already."""
    rows = receipts(spark, folder)
    head = head_of(spark, folder)
    present = rows.where(F.col("body").startswith("click:"))
    out = backfill_bindings(rows, present, head // 4, head // 2)
    return out.drop("received_at")


@query(
    "backfill_progress",
    """with b as (select max(sequence) as head from receipts)
select head//2 as legacy_through, (select max(sequence) from receipts where sequence<=head//3) as backfilled_through, false as done, cast(null as timestamp) as legacy_age_floor from b
union all select head//3, head//3, true, timestamp '2024-02-01 00:00:00' from b""",
    ("receipts",),
)
def backfill_progress_query(spark, folder):
    """A backfill under way, and one that has ended."""
    head = head_of(spark, folder)
    bound = receipts(spark, folder).withColumn("is_legacy", F.col("sequence") <= head // 3)
    ended = "2024-02-01 00:00:00"
    return backfill_progress(bound, head // 2, ended).unionByName(
        backfill_progress(bound, head // 3, ended))


@query(
    "apply_change_log",
    """with last as (select bucket, key, arg_max(value, generation) as value, arg_max(kind, generation) as kind from change_log group by 1,2)
select bucket, key, value from last where kind='put'
union all select bucket, key, value from snapshot where key not in (select key from last)""",
    ("change_log", "snapshot"),
)
def apply_change_log_query(spark, folder):
    log = derived(spark, folder, "change_log").withColumns(
        {"idx": F.lit(0), "sequence": F.lit(None).cast("bigint")}
    )
    return apply_change_log(derived(spark, folder, "snapshot"), log)


@query(
    "change_log_gaps",
    """with k as (select generation from change_log where value not like '1-%' or generation=1),
g as (select generation, lag(generation) over (order by generation) as before from k)
select 'generation_gap' as rule, cast(generation as varchar) as detail from g where generation<>before+1
union all select 'change_kind', generation||'/0' from change_log where value='2-HIGH'
union all select 'generation_bound', cast(generation as varchar) from k where generation>(select max(generation)//2 from change_log)""",
    ("change_log",),
)
def change_log_gaps(spark, folder):
    """A log without its urgent writes and with an unknown kind for the high ones."""
    log = derived(spark, folder, "change_log")
    top = log.agg(F.max("generation")).first()[0]
    kept = log.where(~F.col("value").startswith("1-") | (F.col("generation") == 1)).withColumns(
        {
            "idx": F.lit(0),
            "kind": F.when(F.col("value") == "2-HIGH", "merge").otherwise(F.col("kind")),
        }
    )
    return change_log_violations(kept, top // 2)


def store_state(spark: SparkSession, folder: str, **changes) -> StoreState:
    head = head_of(spark, folder)
    values = {"environment": "prod", "store_id": STORE, "head": head, "floor": head // 2}
    return StoreState(**{**values, **changes})


_AUDIT = f"""with {_CACHE}, b as (select max(sequence) as head, max(sequence)//2 as floor from receipts),
hot as (select sequence, body, env from receipts, b where sequence>floor and body not like 'signup:%'),
v as (select from_sequence, through_sequence from catalog where status='verified'),
w as (select *, coalesce(max(through_sequence) over (order by from_sequence rows between unbounded preceding and 1 preceding),0) as reach from v),
cov as (select coalesce(min(case when from_sequence>reach+1 then reach end), max(through_sequence)) as covered from w),
c as (select *, coalesce(lag(through_sequence) over (order by from_sequence),0) as before from decisions where status='completed')
select 'receipt' as rule, cast(sequence as varchar) as detail from receipts, b where sequence>floor and (body like 'signup:%' or env='env-1')
union all select 'cache', cast(sequence as varchar) from cache where body like 'view:%'
union all select 'cache_bytes', cast(sum(length(body)) as varchar) from cache
union all select 'catalog', set_id from catalog where status<>'verified'
union all select 'floor_not_covered', cast(covered as varchar) from cov, b where floor>covered
union all select 'decision', operation_id from decisions, b where (op_no%10=3) or (status<>'pending' and case when status='completed' then through_sequence else from_sequence-1 end>floor)
union all select 'decision_tiling', cast(from_sequence as varchar) from c where from_sequence<>before+1
union all select 'decision_floor', cast(t as varchar) from (select max(through_sequence) as t from c), b where t<>floor"""


def audited_tables(spark: SparkSession, folder: str) -> dict:
    rows, hot, cache, _ = split_store(spark, folder)
    return {
        "receipts": hot, "bindings": rows, "environments": ["env-0"], "cache": cache,
        "catalog": catalog(spark, folder).withColumns(
            {"environment": F.lit("prod"), "store_id": F.lit(STORE)}
        ),
        "operations": decisions(spark, folder),
    }


@query("audit_violations", _AUDIT, ("receipts", "catalog", "decisions"))
def audit_violations(spark, folder):
    return audit_store(store_state(spark, folder), **audited_tables(spark, folder))


@query(
    "audit_snapshot",
    _AUDIT + """
union all select 'identity', '""" + STORE + """' union all select 'head', cast(head as varchar) from b""",
    ("receipts", "catalog", "decisions"),
)
def audit_snapshot_query(spark, folder):
    state = store_state(spark, folder)
    return audit_snapshot(state, "cd" * 16, state.head + 1, **audited_tables(spark, folder))


@query(
    "index_mismatch",
    """select 'index_mismatch' as rule, cast(sequence as varchar) as detail from receipts where body like 'view:%'
union all select 'index_mismatch', cast(sequence as varchar) from receipts where body like 'error:%'""",
    ("receipts",),
)
def index_mismatch(spark, folder):
    rows = receipts(spark, folder)
    ids = rows.where(~F.col("body").startswith("view:"))
    return index_violations(ids, rows.where(~F.col("body").startswith("error:")))


@query(
    "compare_stores",
    """select sequence, case split_part(body,':',1) when 'view' then 'missing' when 'error' then 'extra' else 'changed' end as difference
from receipts where body like 'view:%' or body like 'error:%' or body like 'signup:%'""",
    ("receipts",),
)
def compare_stores_query(spark, folder):
    rows = receipts(spark, folder)
    ours = rows.where(~F.col("body").startswith("view:")).withColumn(
        "record_sha256",
        F.when(F.col("body").startswith("signup:"), F.lit("x")).otherwise(F.col("record_sha256")),
    )
    return compare_stores(ours, rows.where(~F.col("body").startswith("error:")))


def _fingerprint_sql(table: str, key: str, text: str) -> str:
    """A single-row query for the digest that ``text_fingerprint`` gives."""
    up = "sha256(string_agg(d,'' order by n)) as d"
    return f"""(select sha256(string_agg(d,'' order by n)) from (select n//1000 as n, {up} from (select n//1000 as n, {up} from (select n//1000 as n, {up}
 from (select cast('0x'||substr(sha256({key}),1,5) as bigint) as n, sha256(string_agg(sha256({text}),'' order by {key})) as d from {table} group by 1)
 group by 1) group by 1) group by 1))"""


@query(
    "recovery_compare",
    f"""select 'archive_floor' as field, cast(max(sequence)//2 as varchar) as ours, '7' as expected from receipts
union all select 'operation_history_sha256', {_fingerprint_sql("decisions", "operation_id", "plan_sha256")},
 {_fingerprint_sql("decisions", "operation_id", "case when op_no=0 then 'other' else plan_sha256 end")}""",
    ("receipts", "decisions"),
)
def recovery_compare(spark, folder):
    """A restored copy whose floor and one decision differ from the expected state."""
    ops = decisions(spark, folder).withColumn("text", F.col("plan_sha256"))
    sets = catalog(spark, folder).withColumn("text", F.col("manifest_sha256"))
    changed = ops.withColumn(
        "text", F.when(F.col("op_no") == 0, F.lit("other")).otherwise(F.col("text"))
    )
    ours = recovery_state(store_state(spark, folder), ops, sets, "text", "text")
    theirs = recovery_state(store_state(spark, folder, floor=7), changed, sets, "text", "text")
    return compare_states(ours, theirs)


def backlog(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "backlog").withColumn(
        "modified", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        + F.make_dt_interval(secs=F.col("size"))
    )


@query(
    "backlog_stats",
    """select count(*) as file_count, cast(sum(size) as bigint) as total_bytes, max(greatest(500-size,0)) as oldest_age_seconds from backlog""",
    ("backlog",),
)
def backlog_stats_query(spark, folder):
    return backlog_stats(backlog(spark, folder), "2024-01-01 00:08:20")


@query(
    "backlog_cap",
    """with s as (select *, sum(size) over (order by path desc) as kept, (select sum(size)//3 from backlog) as cap from backlog)
select path, size from s where kept>cap""",
    ("backlog",),
)
def backlog_cap(spark, folder):
    files = backlog(spark, folder)
    cap = files.agg(F.sum("size")).first()[0] // 3
    return backlog_over_cap(files, cap)


@query("replay_order", "select path, size from backlog order by path", ("backlog",))
def replay_order_query(spark, folder):
    return replay_order(derived(spark, folder, "backlog"))
