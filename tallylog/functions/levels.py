"""Severity levels and the fixed texts derived from raw lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallylog.functions.text import present, trim

# Message texts given to container lines.
TRACE_MESSAGE = "emqx broker mqtt trace"
BROKER_MESSAGE = "emqx broker log"


def syslog_level(priority: Column) -> Column:
    return (
        F.when(priority.isin("0", "1", "2", "3"), "error")
        .when(priority == "4", "warn")
        .when(priority == "7", "debug")
        .otherwise("info")
    )


def container_level(message: Column) -> Column:
    lowered = F.lower(message)

    def says(word: str) -> Column:
        return F.contains(lowered, F.lit(f"[{word}]")) | F.contains(lowered, F.lit(f" {word}"))

    return (
        F.when(says("error"), "error")
        .when(says("warning"), "warn")
        .when(says("debug"), "debug")
        .otherwise("info")
    )


def container_message(message: Column) -> Column:
    return F.when(F.lower(message).rlike("publish|subscribe"), TRACE_MESSAGE).otherwise(
        BROKER_MESSAGE
    )


def normalize_level(level: Column) -> Column:
    """Any spelling of a level name; ``warning`` is warn and unknown names are info."""
    name = F.lower(trim(present(level)))
    return (
        F.when(name == "warning", "warn")
        .when(name.isin("debug", "warn", "error", "dpanic", "panic", "fatal"), name)
        .otherwise("info")
    )
