"""Receipt lifecycle: backfill, catalog, retirement, rehydration, cache eviction, protection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallylog.functions.identity import record_digest, sealed_status_digest
from tallylog.functions.text import is_digest, is_safe_id, present
from tallylog.functions.times import ntz
from tallylog.operators.ranges import in_ranges
from tallylog.operators.scan import broken_links, disjoint_ranges, sequence_gaps
from tallylog.schema import MAX_LONG, MAX_RANGE_RECEIPTS, MIN_RETENTION_DAYS
from tallylog.session import checkpointed

# Decision states and the authority states they need.
PENDING, COMPLETED, ABORTED = "pending", "completed", "aborted"
AUTHORITY_ACTIVE, AUTHORITY_ABORT = "ACTIVE", "ABORT_REQUESTED"
#: A plan and a decision must agree on these.
PLAN_COLUMNS = (
    "operation_id", "environment", "store_id", "from_sequence", "through_sequence",
    "plan_sha256", "set_id",
)
STATUS_COLUMNS = (
    *PLAN_COLUMNS, "status", "receipt_sha256", "completed_at", "retired_through",
)


# --- backfill --------------------------------------------------------------------------------

def backfill_bindings(
    receipts: DataFrame, bindings: DataFrame, backfilled_through: int, legacy_through: int,
    batch: int | None = None,
) -> DataFrame:
    """Bindings for old receipts that have none; bodies and sequences never change.

    The next ``batch`` old receipts (all of them by default) after ``backfilled_through`` are
    taken. Their receipt time is unknown: ``received_at`` stays NULL and ``is_legacy`` is set, so
    their age counts from the end of the backfill.
    """
    end = legacy_through if batch is None else min(legacy_through, backfilled_through + batch)
    old = receipts.where(
        (F.col("sequence") > backfilled_through) & (F.col("sequence") <= end)
    )
    missing = old.join(bindings.select("sequence"), "sequence", "left_anti")
    return missing.select(
        "event_id", "sequence", "content_sha256",
        record_digest(F.col("body")).alias("record_sha256"),
        F.lit(None).cast("timestamp_ntz").alias("received_at"),
        F.lit(True).alias("is_legacy"),
    )


def backfill_progress(
    bindings: DataFrame, legacy_through: int, completed_at: str | None = None
) -> DataFrame:
    """One row: legacy_through, backfilled_through, done, legacy_age_floor.

    Old receipts age from ``completed_at``, the durable end of the backfill; before that they have
    no age floor.
    """
    progress = bindings.agg(
        F.lit(legacy_through).cast("bigint").alias("legacy_through"),
        F.coalesce(F.max(F.when(F.col("is_legacy"), F.col("sequence"))), F.lit(0)).alias(
            "backfilled_through"
        ),
    ).withColumn("done", F.col("backfilled_through") >= F.col("legacy_through"))
    floor = ntz(completed_at) if completed_at else F.lit(None).cast("timestamp_ntz")
    return progress.withColumn("legacy_age_floor", F.when(F.col("done"), floor))


def receipt_time(legacy_age_floor: str) -> Column:
    """Stored receipt time; old receipts age from the end of the backfill."""
    return F.when(F.col("is_legacy"), ntz(legacy_age_floor)).otherwise(F.col("received_at"))


# --- catalog ---------------------------------------------------------------------------------

_MANIFEST_PROOF = (
    "manifest_sha256", "high_water", "from_sequence", "through_sequence", "record_count",
    "bindings_sha256",
)


def promote_catalog(
    captures: DataFrame, verifications: DataFrame, catalog: DataFrame, now: str
) -> DataFrame:
    """State of every verification: ``promoted``, ``unchanged`` or ``conflict``.

    A capture that was uploaded becomes a catalog entry when the verification repeats its manifest
    values and is not more than 30 s in the future. Promoting the same again changes nothing; a
    catalog entry with other values is a conflict.
    """
    columns = ("set_id", *_MANIFEST_PROOF)
    joined = (
        verifications.alias("v")
        .join(captures.alias("c"), "set_id", "left")
        .join(catalog.select(*columns, F.lit(True).alias("listed")).alias("k"), "set_id", "left")
    )

    def equal(side: str) -> Column:
        out = F.lit(True)
        for name in _MANIFEST_PROOF:
            out = out & F.col(f"v.{name}").eqNullSafe(F.col(f"{side}.{name}"))
        return out

    latest = ntz(now) + F.expr("interval 30 seconds")
    sound = (
        F.coalesce(F.col("c.status").isin("uploaded", "verified"), F.lit(False))
        & equal("c")
        & (F.col("v.verified_at") <= latest)
        & (F.col("c.created_at") <= latest)
    )
    outcome = (
        F.when(~F.coalesce(sound, F.lit(False)), "conflict")
        .when(F.col("k.listed").isNull(), "promoted")
        .when(equal("k"), "unchanged")
        .otherwise("conflict")
    )
    return joined.select(
        "set_id", *[F.col(f"v.{n}").alias(n) for n in _MANIFEST_PROOF],
        F.col("v.verified_at").alias("verified_at"), F.col("c.created_at").alias("created_at"),
        outcome.alias("outcome"),
    )


# --- retirement ------------------------------------------------------------------------------

def eligible_receipts(
    receipts: DataFrame, bindings: DataFrame, catalog: DataFrame, now: str,
    legacy_age_floor: str = "1970-01-01 00:00:00", retention_days: int = MIN_RETENTION_DAYS,
) -> DataFrame:
    """Per binding: sequence and whether its receipt may be retired.

    The body must be there and agree with its binding, be at least ``retention_days`` old (exactly
    that age counts) and lie in a verified set. ``catalog``: set_id, from_sequence,
    through_sequence. Pass receipts and bindings above the floor only. The result is two narrow
    columns and written once, so planning and applying read it and never the bodies again.
    """
    if retention_days < MIN_RETENTION_DAYS:
        raise ValueError(f"retention is at least {MIN_RETENTION_DAYS} days")
    cut = ntz(now) - F.expr(f"interval {int(retention_days)} days")
    bound = bindings.select(
        "sequence", F.col("content_sha256").alias("_content"),
        F.col("record_sha256").alias("_record"),
        (receipt_time(legacy_age_floor) <= cut).alias("_aged"),
    )
    bodies = receipts.select("sequence", "content_sha256", record_digest(F.col("body")).alias("_d"))
    joined = bound.join(bodies, "sequence", "left")
    sound = (
        F.col("_aged")
        & (F.col("content_sha256") == F.col("_content"))
        & (F.col("_d") == F.col("_record"))
    )
    flagged = joined.select("sequence", F.coalesce(sound, F.lit(False)).alias("_sound"))
    # Overlapping sets are merged first, so a number meets one range at most.
    covered = in_ranges(
        flagged, "sequence", disjoint_ranges(catalog, "from_sequence", "through_sequence"),
        "from_sequence", "through_sequence", how="left",
    )
    return checkpointed(covered.select(
        "sequence", (F.col("_sound") & F.col("from_sequence").isNotNull()).alias("eligible")
    ))


def _furthest(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """(point, set_id, reach): the set that reaches furthest from each point that lies in one; of
    several the smallest id."""
    sets = in_ranges(
        points.select("point"), "point", catalog.select("set_id", "from_sequence", "through_sequence"),
        "from_sequence", "through_sequence",
    )
    best = F.min(F.struct((-F.col("through_sequence")).alias("less"), "set_id")).alias("best")
    return sets.groupBy("point").agg(best).select(
        "point", F.col("best.set_id").alias("set_id"), (-F.col("best.less")).alias("reach"))


def cover_chain(catalog: DataFrame, first: int, last: int) -> DataFrame:
    """(point, set_id, reach): the sets that cover first..last by the fewest stretches.

    From ``first`` on, each stretch is the set that reaches furthest from where the one before ended.
    Every end of a set has such a successor, which is one range look-up; the stretches on the way
    from ``first`` are then found by doubling: each round adds what the stretches found so far reach
    by jumps twice as long. So the rounds are the logarithm of the number of stretches.
    """
    spark = catalog.sparkSession
    start = spark.createDataFrame([(int(first),)], "point bigint")
    ends = catalog.select((F.col("through_sequence") + 1).alias("point")).where(
        F.col("point").between(first + 1, last))
    best = checkpointed(_furthest(start.unionByName(ends).distinct(), catalog))
    jumps = best.select("point", (F.col("reach") + 1).alias("next"))
    found, known = checkpointed(start), 1
    while True:
        reached = found.join(jumps, "point").select(F.col("next").alias("point"))
        found = checkpointed(found.unionByName(reached).distinct())
        count = found.count()
        if count == known:
            break
        known = count
        further = jumps.select(F.col("point").alias("next"), F.col("next").alias("_next"))
        jumps = checkpointed(jumps.join(further, "next").select("point", F.col("_next").alias("next")))
    return best.join(found, "point", "left_semi")


def plan_retirement(
    eligible: DataFrame, catalog: DataFrame, floor: int, head: int,
    chunk: int = MAX_RANGE_RECEIPTS,
) -> DataFrame:
    """Ranges that may be retired next: floor+1 onward, contiguous, at most ``chunk`` each, each
    inside one verified set.

    The eligible prefix ends before the first receipt that is not eligible or not there, which is
    a plain aggregate. It is covered by a chain of sets, each reaching furthest from where the one
    before ended, and each stretch is cut into ranges. The plan covers the whole prefix, however the
    sets overlap.
    """
    if not 1 <= chunk <= MAX_RANGE_RECEIPTS:
        raise ValueError(f"a range has 1 to {MAX_RANGE_RECEIPTS} receipts")
    live = eligible.where((F.col("sequence") > floor) & (F.col("sequence") <= head))
    last = eligible_prefix(live, floor, head).scalar()
    chain = cover_chain(catalog, floor + 1, last).where(F.col("point") <= last)
    end = F.least(F.col("reach"), F.lit(last))
    return chain.select(
        F.explode(F.sequence("point", end, F.lit(int(chunk)).cast("bigint"))).alias("from_sequence"),
        end.alias("_end"), "set_id",
    ).select(
        "from_sequence",
        F.least(F.col("from_sequence") + (chunk - 1), "_end").alias("through_sequence"), "set_id",
    )


def eligible_prefix(live: DataFrame, floor: int, head: int) -> DataFrame:
    """One row ``last``: the end of the prefix floor+1..last that is present and eligible."""
    first, end = F.lit(floor + 1).cast("bigint"), F.lit(head).cast("bigint")
    stops = live.where(~F.col("eligible")).select("sequence").unionByName(
        sequence_gaps(live, "sequence", first, end).select(F.col("gap_from").alias("sequence"))
    )
    return stops.agg((F.coalesce(F.min("sequence"), end + 1) - 1).alias("last"))


def retire(
    receipts: DataFrame, decisions: DataFrame, authority: DataFrame, eligible: DataFrame,
    floor: int, environment: str, store_id: str, now: str,
) -> tuple[DataFrame, DataFrame]:
    """Apply pending decisions: (remaining receipts, decisions after the job).

    Pending decisions that the authority has as ACTIVE, whose receipts are all still eligible and
    that continue the floor without a break are completed and sealed; the others keep their row.
    Receipts of completed decisions lose their body row; a repeated run gives the same result.
    """
    decisions = checkpointed(decisions)
    matched = match_authority(decisions, authority, AUTHORITY_ACTIVE)
    # A range of no or too many receipts is not a decision; it is never expanded.
    width = F.col("through_sequence") - F.col("from_sequence")
    candidates = matched.where(
        (F.col("status") == PENDING) & F.col("authority_ok")
        & (F.col("environment") == environment) & (F.col("store_id") == store_id)
        & (F.col("from_sequence") > floor) & width.between(0, MAX_RANGE_RECEIPTS - 1)
    ).select("operation_id", "from_sequence", "through_sequence")
    sound = in_ranges(
        eligible.where("eligible").select("sequence"), "sequence", candidates,
        "from_sequence", "through_sequence", cell=MAX_RANGE_RECEIPTS,
    ).groupBy("operation_id", "from_sequence", "through_sequence").agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("through_sequence") - F.col("from_sequence") + 1 == F.col("n"))
    # Of decisions on one start the smallest id runs; the first break in the chain ends the run.
    chain = checkpointed(sound.groupBy("from_sequence").agg(
        F.min("operation_id").alias("operation_id"),
        F.min_by("through_sequence", "operation_id").alias("through_sequence"),
    ))
    breaks = broken_links(
        chain.select("from_sequence", "through_sequence"), [], "from_sequence",
        "through_sequence", first=floor + 1,
    )
    first_break = breaks.agg(F.coalesce(F.min("from_sequence"), F.lit(MAX_LONG))).scalar()
    run = chain.where(F.col("from_sequence") < first_break)
    applied = run.select("operation_id", F.lit(True).alias("_applied"))
    after = decisions.join(applied, "operation_id", "left").withColumn(
        "_applied", F.coalesce("_applied", F.lit(False))
    )
    after = after.withColumns(
        {
            "status": F.when(F.col("_applied"), COMPLETED).otherwise(F.col("status")),
            "completed_at": F.when(F.col("_applied"), ntz(now)).otherwise(F.col("completed_at")),
            "retired_through": F.when(
                F.col("_applied"), F.col("through_sequence")
            ).otherwise(F.col("retired_through")),
        }
    )
    after = after.withColumn(
        "receipt_sha256",
        F.when(F.col("_applied"), seal()).otherwise(F.col("receipt_sha256")),
    ).select(*STATUS_COLUMNS)
    done = run.agg(F.coalesce(F.max("through_sequence"), F.lit(floor))).scalar()
    return receipts.where(F.col("sequence") > done), after


def seal() -> Column:
    names = (*PLAN_COLUMNS, "status", "completed_at", "retired_through")
    return sealed_status_digest({name: F.col(name) for name in names})


def match_authority(decisions: DataFrame, authority: DataFrame, expected: str) -> DataFrame:
    """Add ``authority_ok``: the authority's row has the same plan and the expected state."""
    theirs = authority.select(
        *[F.col(name).alias(f"_a_{name}") for name in PLAN_COLUMNS],
        F.col("status").alias("_a_status"),
    )
    joined = decisions.join(
        theirs, decisions["operation_id"] == theirs["_a_operation_id"], "left"
    )
    same = F.col("_a_status") == expected
    for name in PLAN_COLUMNS:
        same = same & (F.col(name) == F.col(f"_a_{name}"))
    return joined.withColumn("authority_ok", F.coalesce(same, F.lit(False))).select(
        *decisions.columns, "authority_ok"
    )


def resolve_operations(
    decisions: DataFrame, requests: DataFrame, authority: DataFrame, floor: int, head: int,
    environment: str, store_id: str, now: str,
) -> DataFrame:
    """Answer plan, apply and abort requests in bulk.

    ``requests``: action and the plan columns; one request per operation. Results carry the
    decision columns after the request and ``outcome``: ``created``, ``unchanged``, ``aborted``,
    ``ready`` (apply may run), ``conflict`` or ``not_found``. ``completed`` and ``aborted`` are
    terminal. An abort of an unknown operation leaves a permanent aborted decision.
    """
    r = {name: F.col(f"r.{name}") for name in PLAN_COLUMNS}
    d = {name: F.col(f"d.{name}") for name in STATUS_COLUMNS}
    states = authority.select(
        "operation_id", F.col("status").alias("auth_status"),
        F.struct(*PLAN_COLUMNS).alias("auth_plan"),
    )
    joined = (
        requests.alias("r")
        .join(decisions.alias("d"), r["operation_id"] == d["operation_id"], "left")
        .join(
            states.alias("a"), r["operation_id"] == F.col("a.operation_id"), "left"
        )
    )
    known = d["operation_id"].isNotNull()
    same = F.lit(True)
    for name in PLAN_COLUMNS:
        same = same & r[name].eqNullSafe(d[name])
    action = F.col("r.action")
    terminal = d["status"].isin(COMPLETED, ABORTED)
    ours = (r["environment"] == environment) & (r["store_id"] == store_id)
    valid = (
        is_safe_id(r["operation_id"]) & is_safe_id(r["set_id"]) & is_digest(r["plan_sha256"])
        & (r["from_sequence"] > 0) & (r["through_sequence"] >= r["from_sequence"])
        & (r["through_sequence"] - r["from_sequence"] < MAX_RANGE_RECEIPTS)
    )
    usable = F.coalesce(valid & ours, F.lit(False))

    def authorised(state: str) -> Column:
        same_plan = F.lit(True)
        for name in PLAN_COLUMNS:
            same_plan = same_plan & F.col(f"auth_plan.{name}").eqNullSafe(
                F.coalesce(d[name], r[name])
            )
        return F.coalesce((F.col("auth_status") == state) & same_plan, F.lit(False))

    plan = (
        F.when(~usable, "conflict")
        .when(known & ~same, "conflict")
        .when(known, "unchanged")
        .when((r["from_sequence"] == floor + 1) & (r["through_sequence"] <= head), "created")
        .otherwise("conflict")
    )
    apply = (
        F.when(~known, "not_found")
        .when(d["status"] == COMPLETED, "unchanged")
        .when((d["status"] == PENDING) & authorised(AUTHORITY_ACTIVE)
              & (d["from_sequence"] == floor + 1), "ready")
        .otherwise("conflict")
    )
    abort = (
        F.when(known & ~same, "conflict")
        .when(known & terminal, "unchanged")
        .when(usable & authorised(AUTHORITY_ABORT), "aborted")
        .otherwise("conflict")
    )
    outcome = (
        F.when(action == "plan", plan).when(action == "apply", apply).when(action == "abort", abort)
    )
    out = joined.withColumn("outcome", F.coalesce(outcome, F.lit("conflict")))
    fresh = F.col("outcome").isin("created", "aborted")
    aborting = F.col("outcome") == "aborted"
    columns = {
        name: F.when(fresh & ~known, r[name]).otherwise(d[name]) for name in PLAN_COLUMNS
    }
    resolved = out.select(
        action.alias("action"),
        r["operation_id"].alias("requested_id"),
        "outcome",
        *[value.alias(name) for name, value in columns.items()],
        F.when(aborting, ABORTED)
        .when(F.col("outcome") == "created", PENDING)
        .otherwise(d["status"]).alias("status"),
        F.when(aborting, ntz(now)).otherwise(d["completed_at"]).alias("completed_at"),
        F.when(fresh, F.lit(floor).cast("bigint"))
        .otherwise(d["retired_through"]).alias("retired_through"),
        d["receipt_sha256"].alias("_old_seal"),
    )
    return resolved.withColumn(
        "receipt_sha256",
        F.when(F.col("outcome") == "aborted", seal()).otherwise(present(F.col("_old_seal"))),
    ).drop("_old_seal")


# --- cache -----------------------------------------------------------------------------------

#: Sequences of one join key of a set.
SET_CELL = 1 << 14


def check_rehydration(
    exports: DataFrame, catalog: DataFrame, bindings: DataFrame, floor: int,
    legacy_age_floor: str = "1970-01-01 00:00:00",
) -> DataFrame:
    """Per exported record (set_id, sequence, content_sha256, received_at, record): ``reason`` it
    may not enter the cache, NULL if it may.

    It must lie in the verified range of its set and at or below the floor, agree with its binding
    and receipt time, and follow the record before it in its set. Sets are checked in bulk; the
    record before is found by an equi-join on (set, sequence), and what is known of a set is repeated
    for each cell of sequences in its range, so one set with all records is many join keys.
    """
    bound = bindings.select(
        "sequence", F.col("content_sha256").alias("_content"),
        F.col("record_sha256").alias("_record"), receipt_time(legacy_age_floor).alias("_time"),
    )
    firsts = exports.groupBy("set_id").agg(F.min("sequence").alias("_first"))
    sets = catalog.where(F.col("status") == "verified").select(
        "set_id", F.col("from_sequence").alias("_from"), F.col("through_sequence").alias("_through")
    )
    # A record outside of its set's range meets no cell of it, which is what not_in_set says.
    facts = firsts.join(sets.where("_through >= _from"), "set_id").withColumn("_cell", F.explode(
        F.expr(f"sequence(_from div {SET_CELL}, _through div {SET_CELL})")))
    before = exports.select("set_id", (F.col("sequence") + 1).alias("sequence")).distinct()
    joined = (
        exports.withColumn("_cell", F.expr(f"sequence div {SET_CELL}"))
        .join(bound, "sequence", "left")
        .join(before.withColumn("_follows", F.lit(True)), ["set_id", "sequence"], "left")
        .join(facts, ["set_id", "_cell"], "left")
        .withColumn(
            "_inside",
            F.when(F.col("sequence").between(F.col("_from"), F.col("_through")), F.lit(True)),
        )
    )
    reason = (
        F.when(F.col("_inside").isNull(), "not_in_set")
        .when(F.col("sequence") > floor, "above_floor")
        .when(
            ~F.coalesce(
                (F.col("content_sha256") == F.col("_content"))
                & (record_digest(F.col("record")) == F.col("_record")),
                F.lit(False),
            ),
            "binding",
        )
        .when(~F.coalesce(F.col("received_at") == F.col("_time"), F.lit(False)), "time")
        .when(
            F.col("_follows").isNull() & (F.col("sequence") != F.col("_first")), "not_contiguous"
        )
    )
    return joined.withColumn("reason", reason).drop(
        "_content", "_record", "_time", "_inside", "_follows", "_first", "_from", "_through", "_cell"
    )


def rehydrate_cache(checked: DataFrame, cache: DataFrame, max_bytes: int) -> DataFrame:
    """The cache after installing checked records, replacing those already there.

    All or nothing: any record with a reason, or a total over ``max_bytes``, raises.
    """
    if not checked.where(F.col("reason").isNotNull()).isEmpty():
        raise ValueError("some records may not enter the cache")
    fresh = checked.select("sequence", F.col("record").alias("body"))
    merged = cache.select("sequence", "body").join(fresh, "sequence", "left_anti").unionByName(
        fresh
    )
    if (cache_bytes(merged).first()[0] or 0) > max_bytes:
        raise ValueError("cache budget exceeded")
    return merged


def cache_bytes(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("bigint").alias("cache_bytes")
    )


def evict_cache(
    cache: DataFrame, through: int, count: int = MAX_RANGE_RECEIPTS
) -> tuple[DataFrame, DataFrame]:
    """(evicted sequences, remaining cache): the lowest ``count`` at or below ``through``."""
    evicted = (
        cache.where(F.col("sequence") <= through).select("sequence")
        .orderBy("sequence").limit(count)
    )
    # At most ``count`` numbers, so their broadcast is bounded.
    return evicted, cache.join(F.broadcast(evicted), "sequence", "left_anti")


# --- protection ------------------------------------------------------------------------------

def protection_status(
    catalog: DataFrame, bindings: DataFrame, head: int, floor: int, now: str,
    legacy_age_floor: str = "1970-01-01 00:00:00",
) -> DataFrame:
    """One row: how fresh and how far the verified copies are.

    ``catalog``: verified_at, high_water, created_at of verified sets.
    """
    totals = catalog.agg(
        F.max("verified_at").alias("last_verified"),
        F.coalesce(F.max("high_water"), F.lit(0)).alias("protected_high_water"),
        F.max("created_at").alias("last_protected_at"),
    )
    first_open = F.col("protected_high_water") + 1
    times = bindings.select("sequence", receipt_time(legacy_age_floor).alias("_at"))
    joined = totals.join(
        times, (F.col("sequence") == first_open) & (first_open <= head), "left"
    )
    overdue = F.col("last_protected_at").isNull() | (
        ntz(now) - F.col("last_protected_at") > F.expr("interval 24 hours")
    )
    return joined.select(
        F.lit(head).cast("bigint").alias("high_water"),
        F.lit(floor).cast("bigint").alias("retired_through"),
        "last_verified", "last_protected_at", "protected_high_water",
        F.col("_at").alias("earliest_unprotected_at"),
        overdue.alias("protection_overdue"),
    )
