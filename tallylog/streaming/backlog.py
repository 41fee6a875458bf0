"""A bounded queue: files above the byte cap are dropped, oldest first, before a stream lists them.

What is dropped is committed to a ledger before a file is deleted, so a run that dies in between
finishes the deletions next time, and no file leaves the queue without a record. A stream that is
started after ``trim`` never lists a dropped file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.session import checkpointed
from tallylog.sources.backlog import backlog_over_cap, list_backlog
from tallylog.sources.tables import BatchTable, removed


@dataclass(frozen=True)
class BacklogLedger:
    spark: SparkSession
    #: The queue's folder and the names of its files.
    folder: str
    path: str
    #: 0 or less means no cap.
    max_bytes: int
    pattern: str = "*.json"

    @property
    def dropped(self) -> BatchTable:
        return BatchTable(self.spark, self.path, "path string, size bigint")

    def trim(self) -> int:
        """Drop the oldest files until the rest fits; how many were dropped now.

        Only names and sizes are read. Files are deleted one after another, as a file system has it,
        without their list being held.
        """
        files = checkpointed(list_backlog(self.spark, self.folder, self.pattern))
        recorded = self.dropped.read().select("path")
        left_over = files.join(recorded, "path", "left_semi")
        kept = files.join(recorded, "path", "left_anti")
        over = checkpointed(backlog_over_cap(kept, self.max_bytes))
        count = over.count()
        if count:
            last = self.dropped.commits().agg(F.max("batch_id")).first()[0]
            number = 0 if last is None else last + 1
            self.dropped.write(over.select("path", "size"), number)
            self.dropped.commit(number)
        for row in left_over.select("path").unionByName(over.select("path")).toLocalIterator():
            removed(self.spark, row["path"])
        return count


_STATUS = (
    "stream string, cursor string, last_upload_at string, last_error string, degraded boolean, "
    "last_uploaded_count bigint"
)


@dataclass(frozen=True)
class StatusTable:
    """The forwarding status of streams as a committed table, one row a stream.

    A micro-batch that was stored writes its number and size and clears the error; one that failed
    keeps both and writes the error. Each step writes the small whole, so the newest batch is all.
    """

    spark: SparkSession
    path: str

    @property
    def _table(self) -> BatchTable:
        return BatchTable(self.spark, self.path, _STATUS)

    def read(self) -> DataFrame:
        table = self._table
        last = table.commits().agg(F.max("batch_id")).first()[0]
        return table.read().where(F.col("batch_id") == F.lit(last)).drop("batch_id")

    def _write(self, stream: str, **changes) -> None:
        last = self._table.commits().agg(F.max("batch_id")).first()[0]
        rows = {r["stream"]: r.asDict() for r in self.read().collect()}  # one a stream
        fresh = {"stream": stream, "cursor": "", "last_upload_at": "", "last_error": "",
                 "degraded": False, "last_uploaded_count": 0}
        rows[stream] = {**rows.get(stream, fresh), **changes}
        order = [c.split()[0] for c in _STATUS.split(", ")]
        frame = self.spark.createDataFrame([tuple(r[c] for c in order) for r in rows.values()], _STATUS)
        number = 0 if last is None else last + 1
        self._table.write(frame.coalesce(1), number)
        self._table.commit(number)

    def stored(self, stream: str, batch_id: int, count: int, at: str) -> None:
        self._write(stream, cursor=f"batch {batch_id}", last_uploaded_count=count, last_upload_at=at,
                    last_error="", degraded=False)

    def failed(self, stream: str, error: Exception) -> None:
        text = str(error).splitlines() or [type(error).__name__]
        self._write(stream, last_error=text[0][:500], degraded=True)
