"""Exported host journals: one JSON object per line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallylog.functions.canonical import shortest_numbers
from tallylog.functions.identity import journal_event_id
from tallylog.functions.levels import syslog_level
from tallylog.functions.redact import redact_event
from tallylog.functions.text import first_trimmed, parse_strict, present, scalar_texts, trim
from tallylog.functions.times import from_epoch_micros, ntz
from tallylog.operators.query import Instant
from tallylog.operators.scan import file_order
from tallylog.operators.stages import computed_once
from tallylog.operators.validate import with_reject_reason
from tallylog.schema import PROMOTED_FIELDS, conform_events


@dataclass(frozen=True)
class JournalConfig:
    service: str = ""
    env: str = ""
    version: str = ""
    #: ``yyyy-MM-dd HH:mm:ss`` UTC used for lines without a usable time; one value per batch.
    ingest_time: str = "1970-01-01 00:00:00"


def lines_in_order(lines: DataFrame) -> DataFrame:
    """(line, arrival) of text files scanned with ``line_columns``, in file and line order."""
    return file_order(lines, "_path", "_start").drop("_path", "_start")


def line_columns() -> list[Column]:
    """What a scan of text files must select for ``lines_in_order``."""
    return [
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    ]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an ``arrival`` number that follows file and line order.

    A read is bounded by the files of its path; the stream bounds files per micro-batch and keeps
    its place in its checkpoint.
    """
    return lines_in_order(spark.read.text(path).select(*line_columns()))


#: Journal keys that stand in for a missing member of the JSON message.
_FALLBACKS = {
    name: name.upper()
    for name in PROMOTED_FIELDS
    if name not in ("level", "msg", "error_category")
}
_KEYS = (
    "__CURSOR", "_BOOT_ID", "_HOSTNAME", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "MESSAGE",
    "PRIORITY", "__REALTIME_TIMESTAMP", *_FALLBACKS.values(),
)


def parse_journal(lines: DataFrame, config: JournalConfig = JournalConfig()) -> DataFrame:
    """Events with ``cursor`` and ``reject_reason``; bad lines are kept with their reason.

    Value precedence is: JSON message member, journal key, configured default, constant. The steps
    are separate projections, so each JSON value is read once and only combined afterwards.
    """
    holder, _ = parse_strict(F.col("line"))
    raw = computed_once(
        lines, ["line", "arrival"], raw=holder, digest=F.sha2("line", 256)
    )
    root = F.schema_of_variant(F.try_variant_get("raw", F.lit("$[0]"), "variant"))
    whole = F.try_variant_get("raw", F.lit("$[1]"), "string") == F.col("digest")
    members = F.try_variant_get("raw", F.lit("$[0]"), "map<string,variant>")
    texts = computed_once(
        raw, ["line", "arrival"],
        is_object=F.coalesce(whole & root.rlike("^(OBJECT|VOID)"), F.lit(False)),
        texts=scalar_texts(members, _KEYS),
    )
    keys = computed_once(
        texts, ["line", "arrival", "is_object"],
        **{f"k_{key}": F.try_element_at("texts", F.lit(key)) for key in _KEYS},
    )

    message = first_trimmed(F.col("k_MESSAGE"), F.lit("journal event"))
    opened = keys.withColumn("message", message).withColumn(
        "body", F.when(F.col("message").startswith("{"), F.col("message"))
    )
    # A message that is one whole JSON object is opened; anything else stays text.
    holder, valid = parse_strict(F.col("body"))
    inner = computed_once(opened, inner=F.when(valid, holder))
    members = F.try_variant_get("inner", F.lit("$[0]"), "map<string,variant>")
    extra = F.map_filter(members, lambda name, _: ~F.lower(trim(name)).isin(*PROMOTED_FIELDS))
    texts = computed_once(
        inner, [*keys.columns, "message"],
        texts=scalar_texts(members, PROMOTED_FIELDS),
        fields=F.nullif(F.to_json(extra), F.lit("{}")),
    )
    # The log's own writer reads numbers as 64-bit ones, so extra fields have them in that spelling.
    texts = texts.withColumn("fields", shortest_numbers(F.col("fields")))
    values = computed_once(
        texts, [*keys.columns, "message", "fields"],
        **{
            f"m_{name}": F.try_element_at("texts", F.lit(name)) for name in PROMOTED_FIELDS
        },
        host=first_trimmed(F.col("k__HOSTNAME"), F.lit("unknown-host")),
        unit=first_trimmed(
            F.col("k__SYSTEMD_UNIT"), F.col("k_SYSLOG_IDENTIFIER"), F.lit("unknown-unit")
        ),
    )

    micros = F.when(
        F.col("k___REALTIME_TIMESTAMP").rlike(r"\A[+-]?\d+\z"),
        F.col("k___REALTIME_TIMESTAMP").try_cast("bigint"),
    )
    defaults = {
        "service": (F.lit(config.service.strip()), F.col("unit")),
        "env": (F.lit(config.env.strip()), F.lit("unknown")),
        "version": (F.lit(config.version.strip()), F.lit("unknown")),
    }
    events = values.withColumns(
        {
            "cursor": present(F.col("k___CURSOR")),
            "event_id": journal_event_id(
                F.col("host"), F.col("k__BOOT_ID"), F.col("unit"), F.col("k___CURSOR")
            ),
            "ts": F.coalesce(from_epoch_micros(micros), ntz(config.ingest_time)),
            "level": first_trimmed(F.col("m_level"), syslog_level(F.col("k_PRIORITY"))),
            "msg": first_trimmed(F.col("m_msg"), F.col("message")),
            "source": F.lit("journald"),
            "error_category": F.col("m_error_category"),
            **{
                name: first_trimmed(
                    F.col(f"m_{name}"), F.col(f"k_{key}"), *defaults.get(name, ())
                )
                for name, key in _FALLBACKS.items()
            },
        }
    )
    events = with_reject_reason(
        conform_events(events, "cursor", "line", "is_object"),
        F.when(~F.col("is_object"), "not a JSON object"),
    )
    return redact_event(events).drop("is_object")


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows with a ``reject_reason``)."""
    return (
        df.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        df.where(F.col("reject_reason").isNotNull()),
    )


_DURATION = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|μs|ms|s|m|h)")
_UNIT_SECONDS = {
    "ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0,
}


def initial_window(df: DataFrame, since: str, ingest_time: str) -> DataFrame:
    """Keep rows from a start on: a duration before ``ingest_time`` (``10m``, ``1h30m``) or an
    absolute RFC 3339 or ``yyyy-MM-dd HH:mm:ss`` time; '' keeps all."""
    since = since.strip()
    if not since:
        return df
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)", since)
    if parts and re.fullmatch(rf"[+-]?(?:{_DURATION.pattern.removeprefix('[+-]?')})+", since):
        seconds = sum(float(number) * _UNIT_SECONDS[unit] for number, unit in parts)
        seconds = -seconds if since.startswith("-") else seconds
        bound = ntz(ingest_time) - F.make_dt_interval(secs=F.lit(round(seconds, 6)))
        return df.where(F.col("ts") >= F.date_trunc("second", bound))
    text = Instant.parse(since).micros if "T" in since else since
    return df.where(F.col("ts") >= ntz(text))
