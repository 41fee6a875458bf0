"""The receipt table and its bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.sources.tables import BatchTable

RECEIPT_SCHEMA = (
    "sequence bigint, event_id string, env string, content_sha256 string, record_sha256 string, "
    "received_at timestamp_ntz, is_legacy boolean, body string"
)
#: What is kept for good once the body is retired.
BINDING_COLUMNS = (
    "event_id", "sequence", "content_sha256", "record_sha256", "received_at", "is_legacy",
)


def receipt_table(spark: SparkSession, path: str) -> BatchTable:
    """Receipts and bindings are one batch directory, so they commit together."""
    return BatchTable(spark, path, RECEIPT_SCHEMA)


def scan_receipts(table: BatchTable, after: int = 0, through: int | None = None) -> DataFrame:
    """Receipts with after < sequence <= through. Files are range-sorted by sequence, so the
    bounds skip row groups; no global sort is made for a range scan."""
    rows = table.read().where(F.col("sequence") > after)
    return rows if through is None else rows.where(F.col("sequence") <= through)


def bindings_of(receipts: DataFrame) -> DataFrame:
    """Column-pruned view of a receipt table: the bodies are not read."""
    return receipts.select(*BINDING_COLUMNS)
