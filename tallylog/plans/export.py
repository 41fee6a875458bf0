"""Exports: capture, manifests, ordered digests and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallylog.functions.canonical import canonical_json
from tallylog.functions.identity import record_digest
from tallylog.functions.text import (
    is_digest, is_safe_id, json_document, parse_strict, present,
)
from tallylog.functions.times import format_rfc3339, parse_rfc3339
from tallylog.functions.usage import usage_bindings
from tallylog.operators.packing import pack_greedy
from tallylog.operators.ranges import in_ranges
from tallylog.operators.scan import BLOCK, broken_links, running, sequence_gaps
from tallylog.operators.stages import computed_once
from tallylog.session import checkpointed
from tallylog.schema import (
    MAX_EXPORT_LINE_BYTES, MAX_PART_BYTES, MAX_RANGE_RECEIPTS, MAX_SEALED_PART_BYTES,
    MAX_SET_BYTES, MAX_SET_PARTS,
)

#: Records per digest block, which is also the largest reconciliation range.
DIGEST_BLOCK = MAX_RANGE_RECEIPTS


# --- source and sink -------------------------------------------------------------------------

def export_line() -> Column:
    """One export record as JSON text; the receipt body is embedded byte for byte."""
    return json_document(
        {
            "sequence": F.col("sequence").cast("string"),
            "content_sha256": present(F.col("content_sha256")),
            "received_at": format_rfc3339(F.col("received_at")),
        },
        ("record", F.col("body")),
    )


def write_exports(lines: DataFrame, path: str) -> None:
    """Write (sequence, line, part) rows as ordered NDJSON, one directory per part.

    A part is at most ``MAX_PART_BYTES``, so shuffling on it keeps every task bounded, and the
    number of writers grows with the number of parts.
    """
    (
        lines.repartition("part")
        .sortWithinPartitions("part", "sequence")
        .select("part", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("part")
        .option("compression", "gzip")
        .text(path)
    )


#: The layout every writer uses; it gives the record byte for byte. Any other member order is
#: read through the JSON parser, which keeps integers but may respell fractions.
_EXPORT_LAYOUT = (
    r'(?s)\A\{"sequence":"\d+","content_sha256":"[^"\\]*","received_at":"[^"\\]*","record":(.*)\}\z'
)
_EXPORT_MEMBERS = ("sequence", "content_sha256", "received_at", "record")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Strict NDJSON read: unknown members, trailing text, wrong types and lines over 2 MiB get a
    ``decode_error``. ``record`` keeps its exact text."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return decode_exports(lines)


def decode_exports(lines: DataFrame) -> DataFrame:
    small = F.when(F.octet_length("line") <= MAX_EXPORT_LINE_BYTES, F.col("line"))
    df = computed_once(
        lines,
        _holder=parse_strict(small)[0],
        _e=F.from_json(
            small,
            "sequence string, content_sha256 string, received_at string, record string",
        ),
    )
    whole = F.try_variant_get("_holder", F.lit("$[1]"), "string") == F.sha2("line", 256)
    members = F.try_variant_get("_holder", F.lit("$[0]"), "map<string,variant>")
    known = F.array(*[F.lit(name) for name in _EXPORT_MEMBERS])
    kinds = F.map_filter(
        members,
        lambda name, value: name.isin("sequence", "content_sha256", "received_at")
        & (F.schema_of_variant(value) != "STRING"),
    )
    # A quoted unsigned integer without sign or leading zeros.
    number = F.when(
        F.col("_e.sequence").rlike(r"\A(0|[1-9]\d*)\z"), F.col("_e.sequence").try_cast("bigint")
    )
    error = (
        F.when(F.octet_length("line") > MAX_EXPORT_LINE_BYTES, "too long")
        .when(~F.coalesce(whole, F.lit(False)) | members.isNull(), "not one JSON object")
        .when(F.size(F.array_except(F.map_keys(members), known)) > 0, "unknown member")
        .when(F.size(kinds) > 0, "wrong type")
        .when(F.coalesce(number, F.lit(0)) < 1, "bad sequence")
        .when(parse_rfc3339(F.col("_e.received_at")).isNull(), "bad time")
    )
    return df.select(
        number.alias("sequence"),
        F.col("_e.content_sha256").alias("content_sha256"),
        parse_rfc3339(F.col("_e.received_at")).alias("received_at"),
        F.coalesce(
            F.nullif(F.regexp_extract("line", _EXPORT_LAYOUT, 1), F.lit("")), F.col("_e.record")
        ).alias("record"),
        error.alias("decode_error"),
    )


def archive_path(
    kind: Column, stack: Column, store_id: Column, created_at: Column, set_id: Column, name: Column
) -> Column:
    """Archive key of a part. The two prefixes and the date layout."""
    prefix = F.when(kind == "events", "billing-raw").otherwise("billing-inbox-snapshots")
    day = F.date_format(created_at, "yyyy/MM/dd")
    return F.concat_ws("/", prefix, stack, store_id, day, set_id, name)


# --- ordered digests -------------------------------------------------------------------------

def binding_json() -> Column:
    return json_document(
        {
            "sequence": F.col("sequence").cast("string"),
            "logger_content_sha256": F.col("content_sha256"),
            "usage_id": F.col("usage_id"),
            "event_sha256": F.col("event_sha256"),
        }
    )


def range_digests(
    bindings: DataFrame, first: int = 1, size: int = DIGEST_BLOCK
) -> DataFrame:
    """Bounded reconciliation ranges of (sequence, content_sha256, usage_id, event_sha256,
    received_at): count, newest receipt time and the digest of the ordered JSON list."""
    rows = bindings.select(
        F.expr(f"(sequence - {first}) div {size}").alias("range_no"),
        "sequence", "received_at", binding_json().alias("json"),
    )
    # A repeated sequence is folded first: its count, and its smallest and largest text. So at most
    # ``size`` entries share a range number, and collecting a range is bounded.
    folded = rows.groupBy("range_no", "sequence").agg(
        F.count(F.lit(1)).alias("n"), F.max("received_at").alias("received_at"),
        F.min("json").alias("low"), F.max("json").alias("high"),
    ).withColumn("json", F.when(F.col("n") == 1, F.col("low")).otherwise(
        F.concat_ws("|", F.col("n").cast("string"), "low", "high")))
    grouped = folded.groupBy("range_no").agg(
        F.min("sequence").alias("from_sequence"),
        F.max("sequence").alias("through_sequence"),
        F.sum("n").alias("record_count"),
        F.max("received_at").alias("max_received_at"),
        F.array_sort(F.collect_list(F.struct("sequence", "json"))).alias("refs"),
    )
    text = F.concat(
        F.lit("["), F.array_join(F.transform("refs", lambda r: r["json"]), ","), F.lit("]")
    )
    return grouped.select(
        "range_no", "from_sequence", "through_sequence", "record_count", "max_received_at",
        F.sha2(text, 256).alias("bindings_sha256"),
        (F.col("through_sequence") - F.col("from_sequence") + 1 == F.col("record_count")).alias(
            "contiguous"
        ),
    )


#: Levels of a digest tree: lists of 1000 digests, four times, hold 10^12 of them.
TREE_DEPTH = 4


def unique_digests(rows: DataFrame, *keys: str, digest: str = "d") -> DataFrame:
    """One digest per key. A key that is there several times gets the digest of its count and of
    its smallest and largest digest, so it is seen and no list of copies is gathered."""
    folded = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(digest).alias("_low"), F.max(digest).alias("_high")
    )
    again = F.sha2(F.concat_ws("|", F.col("_n").cast("string"), "_low", "_high"), 256)
    return folded.select(*keys, F.when(F.col("_n") == 1, F.col("_low")).otherwise(again).alias(digest))


def digest_tree(
    digests: DataFrame, order: str, digest: str, fan_out: int = DIGEST_BLOCK,
    depth: int = TREE_DEPTH,
) -> DataFrame:
    """One row ``root_sha256`` over digests with order numbers from 0, as a tree of lists.

    A sequential digest of a large set cannot be split over tasks. Each of ``depth`` levels hashes
    lists of at most ``fan_out`` digests, always as many levels, so the digest of a history does
    not change its meaning with its size. Numbers must be below ``fan_out`` to the power ``depth``.
    """
    level = unique_digests(digests.select(F.col(order).alias("n"), F.col(digest).alias("d")), "n")
    refs = F.array_sort(F.collect_list(F.struct("n", "d"))).alias("refs")
    joined = F.sha2(F.array_join(F.transform("refs", lambda r: r["d"]), ""), 256)
    for _ in range(depth - 1):
        level = (
            level.groupBy(F.expr(f"n div {fan_out}").alias("n")).agg(refs)
            .select("n", joined.alias("d"))
        )
    return level.agg(refs).select(joined.alias("root_sha256"))


# --- capture ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Capture:
    """Lazy results of one incremental export."""

    from_sequence: int
    through_sequence: int
    #: sequence, line, part
    lines: DataFrame
    #: one row per part: ordinal, bounds, bytes, offset
    parts: DataFrame
    #: one row per reconciliation range
    ranges: DataFrame
    #: one row: record_count, max_received_at, high_water, rejected
    totals: DataFrame


def capture_bounds(captured_through: int, floor: int, head: int) -> tuple[int, int]:
    """Next export range; (0, 0) when there is nothing new."""
    start = max(captured_through, floor) + 1
    return (start, head) if start <= head else (0, 0)


def _with_usage(rows: DataFrame, body: str) -> DataFrame:
    """Add ``_usage``, the usage event's text in a receipt body. It is named many times later."""
    fields = F.from_json(F.col(body), "event struct<fields string>")["event"]["fields"]
    opened = computed_once(rows, _fields=fields)
    usage = F.from_json(canonical_json(F.col("_fields")), "usage_event string")["usage_event"]
    return computed_once(opened, _usage=usage).drop("_fields")


def fitting_part_bytes(rows: DataFrame, part_bytes: int, block: int = BLOCK) -> int:
    """``part_bytes``, or the larger size at which rows (sequence, bytes) surely need no more than
    half of the parts of a set; the other half is for the set's other kind of parts.

    A part that is not the last of its block lacks less than one row of its size. Parts never exceed
    ``MAX_PART_BYTES``: what does not fit then breaks the manifest's rule on totals.
    """
    total, longest, blocks = rows.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0)),
        F.coalesce(F.expr(f"max(sequence) div {block} - min(sequence) div {block} + 1"), F.lit(0)),
    ).first()
    whole = max(MAX_SET_PARTS // 2 - blocks, 1)
    needed = longest + -(-total // whole)
    return min(max(part_bytes, needed), max(part_bytes, MAX_PART_BYTES))


def capture_export(
    receipts: DataFrame, captured_through: int, floor: int, head: int,
    environments: list[str], part_bytes: int = MAX_PART_BYTES, block: int = BLOCK,
) -> Capture:
    """Incremental export of the receipts after the last captured one.

    ``rejected`` in the totals counts receipts that must stop the capture: a foreign environment,
    a body that is not the bound one, an unusable usage event, or a line over the part size.
    """
    if not 1 <= len(set(environments)) == len(environments) <= 8:
        raise ValueError("1 to 8 distinct source environments are needed")
    start, through = capture_bounds(captured_through, floor, head)
    span = receipts.where((F.col("sequence") >= start) & (F.col("sequence") <= through))
    lines = computed_once(span, line=export_line()).withColumn(
        "bytes", (F.octet_length("line") + 1).cast("bigint")
    )
    bound = usage_bindings(_with_usage(lines, "body"), "_usage")
    bad = (
        ~F.col("env").isin(*environments)
        | ~is_safe_id(F.col("env"))
        | (record_digest(F.col("body")) != F.col("record_sha256"))
        | F.col("binding_reason").isNotNull()
        | F.col("received_at").isNull()
        | (F.col("bytes") > part_bytes)
    )
    # Parsing is the dear step, and its narrow result feeds parts, ranges and totals.
    judged = checkpointed(
        bound.select(
            "sequence", "content_sha256", "usage_id", "event_sha256", "received_at", "bytes",
            F.coalesce(bad, F.lit(True)).alias("bad"),
        )
    )
    wanted = fitting_part_bytes(judged, part_bytes, block)
    parts = pack_greedy(judged, "sequence", "bytes", wanted, block=block)
    bounds = parts.select("from_sequence", "through_sequence", F.col("ordinal").alias("part"))
    placed = in_ranges(
        lines.select("sequence", "line"), "sequence", bounds, "from_sequence",
        "through_sequence", cell=1 << 10,
    ).select("sequence", "line", "part")
    totals = judged.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.max("received_at").alias("max_received_at"),
        F.lit(head).cast("bigint").alias("high_water"),
        F.count_if("bad").alias("rejected"),
    )
    return Capture(start, through, placed, parts, range_digests(judged, max(start, 1)), totals)


# --- manifests -------------------------------------------------------------------------------

def part_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("set_id", "kind").agg(
        F.sum("plain_bytes").alias("total_bytes"),
        F.count(F.lit(1)).alias("part_count"),
        F.max("ordinal").alias("max_ordinal"),
    )


def _violations(df: DataFrame, rule: str, *keys: Column) -> DataFrame:
    detail = F.concat_ws("/", *[k.cast("string") for k in keys])
    return df.select("set_id", F.lit(rule).alias("rule"), detail.alias("detail"))


def manifest_violations(manifests: DataFrame, parts: DataFrame) -> DataFrame:
    """(set_id, rule, detail) for every broken manifest rule; no rows means all are valid.

    ``manifests``: one row per set. ``parts``: set_id, name, kind, ordinal, byte_offset,
    plain_bytes, sealed_bytes, plain_sha256, sealed_sha256. Parts are compared along their
    ordinals in blocks, so a set with very many parts does not fall into one task.
    """
    m = F.col
    environments = m("source_environments")
    identity_ok = (
        (m("version") == 1)
        & is_safe_id(m("environment")) & is_safe_id(m("stack")) & is_safe_id(m("set_id"))
        & is_safe_id(m("encryption_key_id"))
        & m("store_id").rlike(r"\A[0-9a-f]{32}\z")
        & is_digest(m("snapshot_sha256")) & is_digest(m("bindings_sha256"))
        & m("snapshot_bytes").between(1, MAX_SET_BYTES)
        & m("created_at").isNotNull()
    )
    environments_ok = (
        F.size(environments).between(1, 8)
        & F.forall(environments, is_safe_id)
        & (F.size(F.array_distinct(environments)) == F.size(environments))
    )
    empty_ok = (
        (m("from_sequence") == 0) & (m("through_sequence") == 0) & m("max_received_at").isNull()
    )
    range_ok = (
        (m("from_sequence") > 0)
        & (m("through_sequence") >= m("from_sequence"))
        & (m("through_sequence") <= m("high_water"))
        & (m("through_sequence") - m("from_sequence") + 1 == m("record_count"))
        & (m("max_received_at") <= m("created_at"))
    )
    fingerprints = m("recipient_fingerprints")
    fingerprints_ok = F.size(fingerprints).between(1, 16) & F.forall(fingerprints, is_digest)

    def broken(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    set_rules = [
        ("identity", broken(identity_ok)),
        ("environments", broken(environments_ok)),
        ("range", broken(F.when(m("record_count") == 0, empty_ok).otherwise(range_ok))),
        ("fingerprints", broken(fingerprints_ok)),
    ]
    per_set = manifests.select(
        "set_id",
        F.explode(
            F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in set_rules]),
                     lambda r: r.isNotNull())
        ).alias("rule"),
        F.lit("").alias("detail"),
    )

    part_ok = (
        m("kind").isin("snapshot", "events") & is_safe_id(m("name"))
        & m("plain_bytes").between(1, MAX_PART_BYTES)
        & m("sealed_bytes").between(1, MAX_SEALED_PART_BYTES)
        & is_digest(m("plain_sha256")) & is_digest(m("sealed_sha256"))
    )
    name = m("name")
    per_part = _violations(parts.where(broken(part_ok)), "part", name)
    repeated = (
        parts.groupBy("set_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    names = _violations(repeated, "part_name", name)

    keys = ["set_id", "kind"]
    numbered = parts.withColumns(
        {c: m(c).cast("bigint") for c in ("ordinal", "byte_offset", "plain_bytes")}
    )
    order = _violations(
        broken_links(
            numbered.select(*keys, "ordinal", m("ordinal").alias("last")), keys, "ordinal", "last"
        ),
        "part_order", m("kind"), m("ordinal"),
    )
    # A negative or absent ordinal is already reported by the order rule.
    usable = numbered.where(m("ordinal") >= 0)
    offsets = running(
        usable, "ordinal", keys, sums={"expected_offset": m("plain_bytes")}, before=True
    ).where(m("byte_offset") != m("expected_offset"))
    offset = _violations(offsets, "part_offset", m("kind"), m("ordinal"))

    totals = parts.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("part_count"),
        F.sum("plain_bytes").alias("total_bytes"),
        F.sum(F.when(m("kind") == "snapshot", m("plain_bytes"))).alias("snapshot_total"),
        F.count_if(m("kind") == "events").alias("event_parts"),
    )
    joined = manifests.join(totals, "set_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in
         ("part_count", "total_bytes", "snapshot_total", "event_parts")}
    )
    totals_ok = (
        m("part_count").between(1, MAX_SET_PARTS)
        & (m("total_bytes") <= MAX_SET_BYTES)
        & (m("snapshot_total") == m("snapshot_bytes"))
        & ((m("record_count") > 0) == (m("event_parts") > 0))
    )
    complete = _violations(joined.where(broken(totals_ok)), "totals", F.lit(""))
    out = per_set
    for rows in (per_part, names, order, offset, complete):
        out = out.unionByName(rows)
    return out


class CaptureError(RuntimeError):
    """A capture holds receipts that must not be exported."""


@dataclass(frozen=True)
class SetIdentity:
    """What a capture's manifest says beside its rows. Times are UTC texts."""

    set_id: str
    environment: str
    stack: str
    store_id: str
    encryption_key_id: str
    created_at: str
    source_environments: tuple[str, ...]
    recipient_fingerprints: tuple[str, ...]


#: Columns of a set's parts.
PART_COLUMNS = (
    "set_id", "name", "kind", "ordinal", "byte_offset", "plain_bytes", "sealed_bytes",
    "plain_sha256", "sealed_sha256",
)


def part_digests(lines: DataFrame, order: str = "sequence") -> DataFrame:
    """(part, plain_sha256) of lines (part, ``order``, line): the digest of the digests of blocks of
    at most 1000 consecutive lines. So no task holds a part, and a changed, lost or moved line shows.
    """
    leaves = lines.select(
        "part", F.expr(f"`{order}` div {DIGEST_BLOCK}").alias("b"), F.col(order).alias("n"),
        F.sha2("line", 256).alias("d"))
    level = unique_digests(leaves, "part", "b", "n")
    for keys, number in ((["part", "b"], "n"), (["part"], "b")):
        refs = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), "d")))
        level = level.groupBy(*keys).agg(refs.alias("refs")).select(*keys, F.sha2(
            F.array_join(F.transform("refs", lambda r: r["d"]), ""), 256).alias("d"))
    return level.withColumnRenamed("d", "plain_sha256")


def _named_parts(parts: DataFrame, digests: DataFrame, set_id: str, kind: str) -> DataFrame:
    name = F.concat(F.lit(f"{kind}-"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
    return parts.join(digests.withColumnRenamed("part", "ordinal"), "ordinal").select(
        F.lit(set_id).alias("set_id"), name.alias("name"), F.lit(kind).alias("kind"), "ordinal",
        "byte_offset", "plain_bytes", "plain_sha256",
    )


def snapshot_lines(bindings: DataFrame) -> DataFrame:
    """(sequence, line): the bindings of a store as the text lines of its snapshot."""
    return bindings.select("sequence", json_document({
        "sequence": F.col("sequence").cast("string"), "event_id": F.col("event_id"),
        "content_sha256": F.col("content_sha256"), "record_sha256": F.col("record_sha256"),
    }).alias("line"))


def capture_manifest(
    capture: Capture, bindings: DataFrame, identity: SetIdentity, sealed: DataFrame | None = None,
    part_bytes: int = MAX_PART_BYTES, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(one manifest row, its parts) of a capture and the snapshot of the store's bindings.

    ``sealed`` (name, sealed_bytes, sealed_sha256) are the parts as an outer step sealed them; without
    it they count as they are. The manifest's digest is that of its own values, parts included.
    Receipts that must stop a capture raise ``CaptureError``.
    """
    rejected, records = capture.totals.select("rejected", "record_count").first()
    if rejected:
        raise CaptureError(f"{rejected} of {records} receipts must not be exported")
    lines = checkpointed(snapshot_lines(bindings).withColumn(
        "bytes", (F.octet_length("line") + 1).cast("bigint")))
    wanted = fitting_part_bytes(lines, part_bytes, block)
    packed = checkpointed(pack_greedy(lines, "sequence", "bytes", wanted, block=block))
    placed = in_ranges(
        lines.select("sequence", "line"), "sequence",
        packed.select("from_sequence", "through_sequence", F.col("ordinal").alias("part")),
        "from_sequence", "through_sequence", cell=1 << 10)
    parts = _named_parts(packed, part_digests(placed), identity.set_id, "snapshot").unionByName(
        _named_parts(capture.parts, part_digests(capture.lines), identity.set_id, "events"))
    if sealed is None:
        parts = parts.withColumns(
            {"sealed_bytes": F.col("plain_bytes"), "sealed_sha256": F.col("plain_sha256")})
    else:
        parts = parts.join(sealed.select("name", "sealed_bytes", "sealed_sha256"), "name", "left")
    # At most ``MAX_SET_PARTS`` rows.
    parts = checkpointed(parts.select(*PART_COLUMNS))
    listed = F.array_sort(F.collect_list(F.struct("kind", "ordinal", "name", "plain_sha256", "sealed_sha256")))
    of_parts = parts.agg(
        F.sum(F.when(F.col("kind") == "snapshot", F.col("plain_bytes"))).alias("snapshot_bytes"),
        listed.alias("_parts"))
    empty = F.col("record_count") == 0
    texts = {k: F.lit(getattr(identity, k)) for k in (
        "set_id", "environment", "stack", "store_id", "encryption_key_id")}
    roots = digest_tree(capture.ranges, "range_no", "bindings_sha256").select(
        F.coalesce("root_sha256", F.sha2(F.lit(""), 256)).alias("bindings_sha256"))
    snapshot = F.filter("_parts", lambda p: p["kind"] == "snapshot")
    row = capture.totals.crossJoin(of_parts).crossJoin(roots).select(  # one row each
        F.lit(1).alias("version"), *[v.alias(k) for k, v in texts.items()],
        F.lit(identity.created_at).cast("timestamp_ntz").alias("created_at"),
        F.array(*map(F.lit, identity.source_environments)).alias("source_environments"),
        F.array(*map(F.lit, identity.recipient_fingerprints)).alias("recipient_fingerprints"),
        F.when(empty, F.lit(0)).otherwise(F.lit(capture.from_sequence)).cast("bigint").alias("from_sequence"),
        F.when(empty, F.lit(0)).otherwise(F.lit(capture.through_sequence)).cast("bigint").alias("through_sequence"),
        "record_count", "high_water", "max_received_at", "bindings_sha256", "snapshot_bytes",
        F.sha2(F.array_join(F.transform(snapshot, lambda p: p["plain_sha256"]), ""), 256).alias("snapshot_sha256"),
        "_parts",
    )
    whole = F.sha2(F.to_json(F.struct(*row.columns)), 256)
    return checkpointed(row.withColumn("manifest_sha256", whole).drop("_parts")), parts


# --- reconciliation --------------------------------------------------------------------------

def reconcile_exports(
    exports: DataFrame, snapshot: DataFrame, from_sequence: int, through_sequence: int,
    environments: list[str],
) -> DataFrame:
    """Rows (sequence, reason) where the exported records and the snapshot differ.

    ``exports``: sequence, content_sha256, received_at, record. ``snapshot``: sequence, env,
    content_sha256, record_sha256, received_at, body. Both sides are unique by sequence once
    repeated export lines are reported, so the join has no hot key.
    """
    inside = F.col("sequence").between(from_sequence, through_sequence)
    repeated = (
        exports.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("sequence", F.lit("repeated").alias("reason"))
    )
    left = exports.select(
        F.col("sequence").alias("e_seq"), F.col("content_sha256").alias("e_content"),
        F.col("received_at").alias("e_time"), F.col("record").alias("e_body"),
    )
    right = snapshot.where(inside).select(
        F.col("sequence").alias("s_seq"), F.col("content_sha256").alias("s_content"),
        F.col("record_sha256").alias("s_record"), F.col("received_at").alias("s_time"),
        F.col("body").alias("s_body"), "env",
    )
    joined = left.join(right, F.col("e_seq") == F.col("s_seq"), "full_outer")
    reason = (
        F.when(F.col("s_seq").isNull(), "not_in_snapshot")
        .when(F.col("e_seq").isNull(), "not_exported")
        .when(~F.col("e_body").eqNullSafe(F.col("s_body")), "body")
        .when(~F.col("env").isin(*environments), "environment")
        .when(~F.col("e_time").eqNullSafe(F.col("s_time")), "time")
        .when(
            (F.col("e_content") != F.col("s_content"))
            | (record_digest(F.col("e_body")) != F.col("s_record")),
            "binding",
        )
    )
    differing = joined.select(
        F.coalesce("e_seq", "s_seq").alias("sequence"), reason.alias("reason")
    ).where(F.col("reason").isNotNull())
    return differing.unionByName(repeated)


def audit_exports(
    exports: DataFrame, snapshot: DataFrame, manifest: dict, captured_through: int, floor: int,
) -> DataFrame:
    """(rule, detail) for every way an export set differs from its snapshot and manifest.

    ``manifest``: from_sequence, through_sequence, record_count, high_water, max_received_at
    (text), environments and, optionally, root_sha256 of the digest tree.
    """
    spark = exports.sparkSession
    start, through = manifest["from_sequence"], manifest["through_sequence"]
    expected, _ = capture_bounds(captured_through, floor, manifest["high_water"])
    found = []
    if expected != start:
        found.append(("start", str(expected)))
    if start and through - start + 1 != manifest["record_count"]:
        found.append(("count", str(manifest["record_count"])))
    out = spark.createDataFrame(found, "rule string, detail string")
    rows = reconcile_exports(exports, snapshot, start, through, manifest["environments"])
    out = out.unionByName(
        rows.select(
            F.concat(F.lit("record:"), "reason").alias("rule"),
            F.col("sequence").cast("string").alias("detail"),
        )
    )
    gaps = sequence_gaps(
        exports, "sequence", F.lit(start).cast("bigint"), F.lit(through).cast("bigint")
    )
    out = out.unionByName(
        gaps.select(
            F.lit("gap").alias("rule"),
            F.concat_ws("-", "gap_from", "gap_through").alias("detail"),
        )
    )
    newest = F.lit(manifest["max_received_at"]).cast("timestamp_ntz")
    times = exports.agg(F.max("received_at").alias("t")).where(~F.col("t").eqNullSafe(newest))
    out = out.unionByName(
        times.select(F.lit("max_time").alias("rule"), F.col("t").cast("string").alias("detail"))
    )
    if manifest.get("root_sha256"):
        root = export_root(exports, start, through)
        out = out.unionByName(
            root.where(F.col("root_sha256") != manifest["root_sha256"]).select(
                F.lit("bindings_digest").alias("rule"), F.col("root_sha256").alias("detail")
            )
        )
    return out


def export_root(exports: DataFrame, start: int, through: int) -> DataFrame:
    """``root_sha256`` of the ordered usage bindings of an export set."""
    bound = usage_bindings(_with_usage(exports, "record"), "_usage")
    ranges = range_digests(bound, start)
    return digest_tree(ranges, "range_no", "bindings_sha256")
