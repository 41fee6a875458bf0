"""Exported container logs: ``<RFC 3339 time> <message>`` lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallylog.functions.identity import container_event_id
from tallylog.functions.levels import container_level, container_message
from tallylog.functions.redact import redact_text
from tallylog.functions.text import first_non_empty, json_document, trim
from tallylog.functions.times import format_rfc3339, ntz, parse_rfc3339, rfc3339_sub
from tallylog.operators.stages import computed_once
from tallylog.operators.validate import with_reject_reason
from tallylog.schema import conform_events


@dataclass(frozen=True)
class ContainerConfig:
    container: str
    service: str = ""
    env: str = ""
    version: str = ""
    host: str = ""
    unit: str = ""
    source: str = ""
    component: str = ""
    operation_id: str = ""
    #: UTC time given to lines without one; those lines are told apart by their arrival number.
    ingest_time: str = "1970-01-01 00:00:00"


def split_timestamp(df: DataFrame, line: str) -> DataFrame:
    """Add ``time_text`` and ``message``: the first space splits; without one all is message."""
    df = computed_once(df, _trimmed=trim(F.col(line)))
    at = F.instr("_trimmed", " ")
    return df.withColumns(
        {
            "time_text": F.left("_trimmed", F.greatest(at - 1, F.lit(0))),
            "message": F.when(at > 0, F.substr("_trimmed", at + 1)).otherwise(F.col(line)),
        }
    ).drop("_trimmed")


def parse_container(lines: DataFrame, config: ContainerConfig) -> DataFrame:
    """Events with ``cursor`` and ``reject_reason`` from (line, arrival) rows.

    The message is redacted before its id and level are taken, so secret lines of one time share
    an id. A line without a readable time takes the batch time, and its arrival number as the
    nanoseconds of its cursor text keeps its id stable across a retry.
    """
    split = split_timestamp(lines, "line")
    df = computed_once(
        split, ["arrival", "time_text"],
        _ts=parse_rfc3339(F.col("time_text")),
        message=redact_text(trim(F.col("message"))),
    )
    known = F.col("_ts").isNotNull()
    fallback = F.concat(
        format_rfc3339(ntz(config.ingest_time)), F.lit("#"), F.col("arrival").cast("string")
    )
    df = df.withColumn("cursor", F.when(known, F.col("time_text")).otherwise(fallback))
    container = F.lit(config.container)
    constants = {
        "service": (config.service, config.container, "docker"),
        "env": (config.env, "unknown"),
        "version": (config.version, "unknown"),
        "host": (config.host, "unknown-host"),
        "unit": (config.unit, config.container),
        "source": (config.source, "docker"),
        "operation_id": (config.operation_id,),
        "component": (config.component,),
    }
    df = df.withColumns(
        {
            "event_id": container_event_id(container, F.col("cursor"), F.col("message")),
            "ts": F.coalesce("_ts", ntz(config.ingest_time)),
            "ts_sub": F.when(known, rfc3339_sub(F.col("time_text"))).otherwise(
                F.lit(0).cast("smallint")
            ),
            "level": container_level(F.col("message")),
            "msg": container_message(F.col("message")),
            "fields": json_document(
                {"container": redact_text(container), "log_line": F.col("message")}
            ),
            **{
                name: first_non_empty(*[F.lit(text) for text in texts])
                for name, texts in constants.items()
            },
        }
    )
    return with_reject_reason(conform_events(df, "cursor"))
