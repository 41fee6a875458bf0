"""Raw access rows as request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallylog.functions.paths import remote_host, sanitize_path
from tallylog.functions.text import present, trim


def request_events(access: DataFrame) -> DataFrame:
    """One ``http request`` event per row of (method, target, status, micros, address, request_id).

    The status defaults to 200 and the duration is in milliseconds.
    """
    return access.withColumns(
        {
            "level": F.lit("info"),
            "msg": F.lit("http request"),
            "path": sanitize_path(F.col("target")),
            "status": F.coalesce(F.col("status").cast("int"), F.lit(200)),
            "duration_ms": F.col("micros") / F.lit(1000.0),
            "remote_addr": remote_host(F.col("address")),
            "request_id": F.nullif(trim(present(F.col("request_id"))), F.lit("")),
        }
    ).drop("target", "micros", "address")
