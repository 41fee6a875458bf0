"""Filtered, time-ordered, bounded event queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from tallylog.functions.text import present
from tallylog.functions.times import ntz
from tallylog.schema import DEFAULT_QUERY_LIMIT, MAX_QUERY_LIMIT, USAGE_MARKER

_RFC3339 = re.compile(
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})"
)
#: The filters that are also storage labels; they prune partitions or row groups.
LABEL_FILTERS = ("env", "service", "host", "unit", "level", "stream")


class QueryError(ValueError):
    """A query parameter is out of bounds."""


@dataclass(frozen=True)
class Instant:
    """UTC microsecond text and the nanoseconds below it."""

    micros: str
    sub: int

    @staticmethod
    def parse(text: str) -> Instant:
        match = _RFC3339.fullmatch(text)
        if not match:
            raise ValueError(text)
        digits = (match[2] or "").ljust(9, "0")[:9]
        zone = "+00:00" if match[3] == "Z" else match[3]
        moment = datetime.fromisoformat(match[1] + zone).astimezone(timezone.utc)
        moment += timedelta(microseconds=int(digits[:6]))
        return Instant(moment.strftime("%Y-%m-%d %H:%M:%S.%f"), int(digits[6:]))


@dataclass(frozen=True)
class EventQuery:
    """Equality filters ('' means no filter), an inclusive time range, an order and a limit."""

    since: str = ""
    until: str = ""
    limit: int = DEFAULT_QUERY_LIMIT
    order: str = "desc"
    event_id: str = ""
    env: str = ""
    service: str = ""
    host: str = ""
    unit: str = ""
    level: str = ""
    source: str = ""
    stream: str = ""
    trace_id: str = ""
    request_id: str = ""
    operation_id: str = ""
    device_id: str = ""
    org_id: str = ""
    user_id: str = ""
    component: str = ""
    actor_id: str = ""
    actor_type: str = ""
    outcome: str = ""
    status_code: str = ""
    status_class: str = ""

    @classmethod
    def from_params(cls, params: dict[str, str]) -> EventQuery:
        """Build from text parameters; unknown names are ignored, bad values raise QueryError."""
        values = {f.name: params[f.name] for f in fields(cls) if params.get(f.name)}
        text = values.pop("limit", None)
        if text is not None:
            if not re.fullmatch(r"[+-]?\d+", str(text)):
                raise QueryError("limit must be an integer")
            values["limit"] = int(text)
        values["order"] = values.get("order", "").strip() or "desc"
        return cls(**values)

    def __post_init__(self):
        for name in ("since", "until"):
            self._instant(name)
        if not 1 <= self.limit <= MAX_QUERY_LIMIT:
            raise QueryError(f"limit must be between 1 and {MAX_QUERY_LIMIT}")
        if self.order not in ("asc", "desc"):
            raise QueryError("order must be asc or desc")
        if USAGE_MARKER in (self.stream, self.source):
            raise QueryError("usage events are not part of event queries")

    def _instant(self, name: str) -> Instant | None:
        text = getattr(self, name)
        if not text:
            return None
        try:
            return Instant.parse(text)
        except ValueError as error:
            raise QueryError(f"{name} must be RFC3339") from error

    def predicate(self) -> list[Column]:
        """Conjuncts in pushable form: plain comparisons of columns with literals."""
        bounds = ("since", "until", "limit", "order")
        out = [
            F.col(f.name) == getattr(self, f.name)
            for f in fields(self)
            if f.name not in bounds and getattr(self, f.name)
        ]
        since, until = self._instant("since"), self._instant("until")
        ts, sub = F.col("ts"), F.coalesce(F.col("ts_sub"), F.lit(0))
        if since:
            out.append(ts >= ntz(since.micros))
            if since.sub:
                out.append((ts > ntz(since.micros)) | (sub >= since.sub))
        if until:
            out.append(ts <= ntz(until.micros))
            if until.sub != 999:
                out.append((ts < ntz(until.micros)) | (sub <= until.sub))
        return out

    def ordering(self) -> list[Column]:
        """Time, then event id, both in the query's direction; ids compare as bytes."""
        columns = [F.col("ts"), F.coalesce(F.col("ts_sub"), F.lit(0)), F.col("event_id")]
        return [c.asc() if self.order == "asc" else c.desc() for c in columns]


def operational_only(df: DataFrame) -> DataFrame:
    """Hide usage events, whichever marker they carry."""
    return df.where(
        (present(F.col("stream")) != USAGE_MARKER) & (present(F.col("source")) != USAGE_MARKER)
    )


def query_events(events: DataFrame, query: EventQuery, dedupe: bool = True) -> DataFrame:
    """Filter, keep the first arrival of each id, order and limit.

    Duplicates and order are settled on four narrow columns; only the chosen rows, at most
    ``MAX_QUERY_LIMIT``, are then read in full through a broadcast of their arrival numbers.
    ``dedupe=False`` is for tables written by the ingest job, which are unique by id already.
    """
    matching = operational_only(events)
    for condition in query.predicate():
        matching = matching.where(condition)
    if not dedupe:
        return matching.orderBy(*query.ordering()).limit(query.limit)
    firsts = matching.groupBy("event_id").agg(
        F.min("arrival").alias("arrival"),
        F.min_by("ts", "arrival").alias("ts"),
        F.min_by("ts_sub", "arrival").alias("ts_sub"),
    )
    chosen = firsts.orderBy(*query.ordering()).limit(query.limit).select("arrival")
    rows = matching.join(F.broadcast(chosen), "arrival", "left_semi")
    # A bounded sort: the limit changes nothing but spares the range shuffle of a full sort.
    return rows.orderBy(*query.ordering()).limit(query.limit)
