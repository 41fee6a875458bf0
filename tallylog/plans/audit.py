"""Whole-store audits and fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallylog.functions.identity import record_digest
from tallylog.functions.text import is_digest, is_safe_id, json_document, present
from tallylog.operators.multiset import as_text, combined, fingerprint
from tallylog.operators.scan import broken_links, covered_prefix, sequence_gaps
from tallylog.plans.changes import change_log_violations
from tallylog.plans.export import digest_tree, unique_digests
from tallylog.plans.lifecycle import ABORTED, COMPLETED, PENDING, cache_bytes, seal
from tallylog.schema import MAX_RANGE_RECEIPTS, MAX_RECEIPT_ID_BYTES
from tallylog.sources.tables import BatchTable


@dataclass(frozen=True)
class StoreState:
    """The scalars of a store."""

    environment: str
    store_id: str
    head: int
    floor: int = 0
    legacy_through: int = 0
    backfilled_through: int = 0
    cache_bytes: int = 0
    generation: int = 1


def _rule(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _not(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def state_violations(store: StoreState, bindings: DataFrame) -> DataFrame:
    found = []
    if store.floor > store.head or store.floor < 0:
        found.append(("floor", str(store.floor)))
    if store.legacy_through > store.head or store.backfilled_through != store.legacy_through:
        found.append(("legacy", str(store.backfilled_through)))
    if store.generation < 1:
        found.append(("generation", str(store.generation)))
    return bindings.sparkSession.createDataFrame(found, "rule string, detail string")


def binding_violations(store: StoreState, bindings: DataFrame) -> DataFrame:
    """Each binding is well formed, ids and sequences are unique, and 1..head is complete."""
    sequence = F.col("sequence")
    malformed = bindings.where(
        _not(
            F.octet_length("event_id").between(1, MAX_RECEIPT_ID_BYTES)
            & sequence.between(1, store.head)
            & is_digest(F.col("content_sha256"))
            & is_digest(F.col("record_sha256"))
            & (F.col("received_at").isNotNull() | F.col("is_legacy"))
        )
    )
    out = _rule(malformed, "binding", sequence)
    for rule, key in (("id_repeated", "event_id"), ("sequence_repeated", "sequence")):
        repeated = bindings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(_rule(repeated, rule, F.col(key)))
    gaps = sequence_gaps(
        bindings, "sequence", F.lit(1).cast("bigint"), F.lit(store.head).cast("bigint")
    )
    return out.unionByName(
        _rule(gaps, "sequence_gap", F.concat_ws("-", "gap_from", "gap_through"))
    )


def index_violations(ids: DataFrame, receipt_ids: DataFrame) -> DataFrame:
    """Where the id index (event_id, sequence) and the sequence index (sequence, event_id) of a
    store that keeps both do not mirror each other."""
    left = ids.select(F.col("event_id").alias("i_id"), F.col("sequence").alias("i_seq"))
    right = receipt_ids.select(F.col("event_id").alias("r_id"), F.col("sequence").alias("r_seq"))
    joined = left.join(
        right, (F.col("i_seq") == F.col("r_seq")) & (F.col("i_id") == F.col("r_id")), "full_outer"
    ).where(F.col("i_id").isNull() | F.col("r_id").isNull())
    return _rule(joined, "index_mismatch", F.coalesce("i_seq", "r_seq"))


def receipt_violations(
    store: StoreState, receipts: DataFrame, bindings: DataFrame, environments: list[str],
    rule: str = "receipt",
) -> DataFrame:
    """Live receipts lie above the floor and equal their binding; none is missing."""
    theirs = bindings.where(F.col("sequence") > store.floor).select(
        F.col("sequence").alias("_seq"), F.col("event_id").alias("_id"),
        F.col("content_sha256").alias("_content"), F.col("record_sha256").alias("_record"),
    )
    ours = receipts.select(
        "sequence", "event_id", "env", "content_sha256",
        record_digest(F.col("body")).alias("_digest"),
    )
    joined = ours.join(theirs, F.col("sequence") == F.col("_seq"), "full_outer")
    equal = (
        (F.col("event_id") == F.col("_id"))
        & (F.col("content_sha256") == F.col("_content"))
        & (F.col("_digest") == F.col("_record"))
        & F.col("env").isin(*environments)
        & F.col("sequence").between(store.floor + 1, store.head)
    )
    return _rule(joined.where(_not(equal)), rule, F.coalesce("sequence", "_seq"))


def cache_violations(store: StoreState, cache: DataFrame, bindings: DataFrame) -> DataFrame:
    """Cached bodies lie at or below the floor, equal their binding and add up to the total."""
    theirs = bindings.select("sequence", F.col("record_sha256").alias("_record"))
    joined = cache.select("sequence", record_digest(F.col("body")).alias("_digest")).join(
        theirs, "sequence", "left"
    )
    wrong = joined.where(
        _not(
            F.col("sequence").between(1, store.floor) & (F.col("_digest") == F.col("_record"))
        )
    )
    total = cache_bytes(cache).where(F.col("cache_bytes") != store.cache_bytes)
    return _rule(wrong, "cache", F.col("sequence")).unionByName(
        _rule(total, "cache_bytes", F.col("cache_bytes"))
    )


def catalog_violations(store: StoreState, catalog: DataFrame) -> DataFrame:
    """Catalog entries are verified, belong to this store and cover the retired prefix."""
    foreign = catalog.where(
        _not(
            (F.col("status") == "verified")
            & (F.col("store_id") == store.store_id)
            & (F.col("environment") == store.environment)
        )
    )
    covered = covered_prefix(
        catalog.where((F.col("status") == "verified") & (F.col("record_count") > 0)),
        "from_sequence", "through_sequence",
    ).where(F.lit(store.floor) > F.col("covered"))
    return _rule(foreign, "catalog", F.col("set_id")).unionByName(
        _rule(covered, "floor_not_covered", F.col("covered"))
    )


def decision_violations(store: StoreState, operations: DataFrame) -> DataFrame:
    """Decisions are well formed, sealed when terminal, and the completed ones tile 1..floor."""
    c = F.col
    shaped = (
        is_safe_id(c("operation_id"))
        & (c("environment") == store.environment) & (c("store_id") == store.store_id)
        & is_digest(c("plan_sha256"))
        & (c("from_sequence") > 0) & (c("through_sequence") >= c("from_sequence"))
        & (c("through_sequence") - c("from_sequence") < MAX_RANGE_RECEIPTS)
        & (c("through_sequence") <= store.head)
    )
    unsealed = (present(c("receipt_sha256")) == "") & c("completed_at").isNull()
    sealed = (
        (c("receipt_sha256") == seal())
        & c("completed_at").isNotNull()
        & (c("retired_through") <= store.floor)
        & ((c("status") == ABORTED) | (c("retired_through") == c("through_sequence")))
    )
    state = F.when(c("status") == PENDING, unsealed).when(
        c("status").isin(COMPLETED, ABORTED), sealed
    )
    wrong = operations.where(_not(shaped) | _not(state))
    return _rule(wrong, "decision", c("operation_id")).unionByName(
        tiling_violations(operations, store.floor)
    )


def tiling_violations(operations: DataFrame, floor: int) -> DataFrame:
    """Completed decisions must cover 1..floor without hole or overlap."""
    completed = operations.where(F.col("status") == COMPLETED)
    broken = broken_links(
        completed.select("from_sequence", "through_sequence"), [], "from_sequence",
        "through_sequence",
    )
    top = completed.agg(F.coalesce(F.max("through_sequence"), F.lit(0)).alias("top")).where(
        F.col("top") != floor
    )
    return _rule(broken, "decision_tiling", F.col("from_sequence")).unionByName(
        _rule(top, "decision_floor", F.col("top"))
    )


def audit_store(
    store: StoreState,
    receipts: DataFrame,
    bindings: DataFrame,
    environments: list[str],
    cache: DataFrame | None = None,
    catalog: DataFrame | None = None,
    operations: DataFrame | None = None,
    change_log: DataFrame | None = None,
) -> DataFrame:
    """(rule, detail) for every broken rule; an empty result means the store is sound.

    The rules are independent queries over pruned columns and are planned together, so Spark runs
    them side by side.
    """
    out = state_violations(store, bindings)
    checks = [
        binding_violations(store, bindings),
        receipt_violations(store, receipts, bindings, environments),
    ]
    if cache is not None:
        checks.append(cache_violations(store, cache, bindings))
    if catalog is not None:
        checks.append(catalog_violations(store, catalog))
    if operations is not None:
        checks.append(decision_violations(store, operations))
    if change_log is not None:
        checks.append(change_log_violations(change_log, store.generation))
    for rows in checks:
        out = out.unionByName(rows)
    return out


def audit_snapshot(
    store: StoreState, expected_store_id: str, expected_head: int, receipts: DataFrame,
    bindings: DataFrame, environments: list[str], expected_fingerprint: str | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Audit of a copied store, with its identity, frontier and the fingerprint of all bindings.

    ``expected_fingerprint`` is the text that the source kept, see ``FingerprintLog``.
    """
    found = []
    if store.store_id != expected_store_id:
        found.append(("identity", store.store_id))
    if store.head != expected_head:
        found.append(("head", str(store.head)))
    own = receipts.sparkSession.createDataFrame(found, "rule string, detail string")
    if expected_fingerprint is not None:
        ours = fingerprint(bindings, list(FINGERPRINTED)).select(as_text().alias("f"))
        own = own.unionByName(
            _rule(ours.where(F.col("f") != expected_fingerprint), "fingerprint", F.col("f")))
    return own.unionByName(audit_store(store, receipts, bindings, environments, **tables))


# --- fingerprints ----------------------------------------------------------------------------

#: Columns of a binding that a copy must repeat.
FINGERPRINTED = ("sequence", "event_id", "content_sha256", "record_sha256")


@dataclass(frozen=True)
class FingerprintLog:
    """Fingerprints of the batches of a committed table, each computed once from that batch alone."""

    table: BatchTable
    path: str
    columns: tuple[str, ...] = FINGERPRINTED

    @property
    def _kept(self) -> BatchTable:
        words = ", ".join(f"w{i} decimal(38,0)" for i in range(8))
        return BatchTable(self.table.spark, self.path, f"n bigint, {words}")

    def record(self, batch_id: int) -> None:
        """Keep the fingerprint of a committed batch; again, it changes nothing."""
        if self._kept.has(batch_id):
            return
        rows = self.table.read().where(F.col("batch_id") == int(batch_id))
        self._kept.write(fingerprint(rows, list(self.columns)).coalesce(1), batch_id)
        self._kept.commit(batch_id)

    def total(self) -> DataFrame:
        """One row: n, the words and ``fingerprint`` as text, over all recorded batches."""
        return combined(self._kept.read()).withColumn("fingerprint", as_text())



def bindings_fingerprint(bindings: DataFrame) -> DataFrame:
    """One row ``root_sha256`` over all bindings in sequence order, as a digest tree."""
    document = json_document(
        {
            "event_id": F.col("event_id"),
            "sequence": F.col("sequence").cast("string"),
            "content_sha256": F.col("content_sha256"),
            "record_sha256": F.col("record_sha256"),
        }
    )
    leaves = bindings.select((F.col("sequence") - 1).alias("n"), F.sha2(document, 256).alias("d"))
    return digest_tree(leaves, "n", "d")


#: Hexadecimal digits of a key's digest that choose its bucket: 2^20 buckets.
_BUCKET_DIGITS = 5


def text_fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row ``digest`` over texts by key; equal tables give equal digests.

    Texts are digested by hash bucket of their key, ordered by key inside, and the buckets go into
    a digest tree. The number of buckets is fixed, so one formula holds for every size; 10^9 keys
    put about 1000 digests into a bucket.
    """
    leaves = rows.select(F.col(key).alias("k"), F.sha2(F.col(text), 256).alias("d"))
    bucket = F.conv(F.substring(F.sha2(F.col("k"), 256), 1, _BUCKET_DIGITS), 16, 10).cast("bigint")
    level = (
        unique_digests(leaves, "k").groupBy(bucket.alias("b"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("leaves"))
        .select(
            "b", F.sha2(F.array_join(F.transform("leaves", lambda x: x["d"]), ""), 256).alias("d")
        )
    )
    return digest_tree(level, "b", "d").withColumnRenamed("root_sha256", "digest")


def recovery_state(
    store: StoreState, operations: DataFrame, catalog: DataFrame, operation_text: str,
    catalog_text: str,
) -> DataFrame:
    """One row: identity, frontier, floor and the digests of both histories."""
    ops = text_fingerprint(operations, "operation_id", operation_text)
    sets = text_fingerprint(catalog, "set_id", catalog_text)
    return operations.sparkSession.range(1).select(
        F.lit(store.environment).alias("environment"),
        F.lit(store.store_id).alias("store_id"),
        F.lit(store.head).cast("bigint").alias("high_water"),
        F.lit(store.floor).cast("bigint").alias("archive_floor"),
        ops.scalar().alias("operation_history_sha256"),
        sets.scalar().alias("archive_dependency_sha256"),
    )


def compare_states(ours: DataFrame, expected: DataFrame) -> DataFrame:
    """(field, ours, expected) for each differing field of two ``recovery_state`` rows."""
    names = [c for c in ours.columns if c in expected.columns]

    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias(side)) for n in names]
        )
        return df.select(F.inline(pairs))

    return (
        long(ours, "ours").join(long(expected, "expected"), "field", "full_outer")
        .where(~F.col("ours").eqNullSafe(F.col("expected")))
    )


def compare_stores(ours: DataFrame, expected: DataFrame) -> DataFrame:
    """(sequence, difference) between two binding tables: ``missing``, ``extra`` or ``changed``."""
    columns = ("event_id", "content_sha256", "record_sha256")
    a = ours.select(F.col("sequence").alias("a_seq"), F.struct(*columns).alias("a"))
    b = expected.select(F.col("sequence").alias("b_seq"), F.struct(*columns).alias("b"))
    joined = a.join(b, F.col("a_seq") == F.col("b_seq"), "full_outer")
    difference = (
        F.when(F.col("a_seq").isNull(), "missing")
        .when(F.col("b_seq").isNull(), "extra")
        .when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    )
    return joined.select(
        F.coalesce("a_seq", "b_seq").alias("sequence"), difference.alias("difference")
    ).where(F.col("difference").isNotNull())
