"""Committed-batch tables on plain Parquet.

One batch is one directory ``data/batch_id=N`` that a retry overwrites as a whole, and a row in
``commits`` written last. Readers see committed batches only, so a job that died halfway, or a
task that ran twice, leaves nothing behind that anyone reads. One writer per table.

Every ``FOLD`` batches the commit file holds all earlier rows and replaces their files, so a reader
opens at most ``FOLD`` commit files however many batches there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

_COMMIT_SCHEMA = StructType(
    [StructField("batch_id", LongType()), StructField("head", LongType())]
)


#: Commit files that a reader meets at most.
FOLD = 32


def _missing(error: AnalysisException) -> bool:
    """Only a path that is not there means an empty table; anything else is an error."""
    return error.getCondition() == "PATH_NOT_FOUND"


def _folder(spark: SparkSession, path: str):
    """Hadoop's handle of a path and its file system, which may be any that Spark reads."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of the entries of a folder; none if it is not there."""
    found, system = _folder(spark, path)
    return [s.getPath().toString() for s in system.listStatus(found)] if system.exists(found) else []


def removed(spark: SparkSession, path: str) -> None:
    found, system = _folder(spark, path)
    system.delete(found, True)


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def write(self, df: DataFrame, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
        """Write (or rewrite) one batch; it is not visible before ``commit``."""
        target = f"{self.path}/data/batch_id={int(batch_id)}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)

    def commit(self, batch_id: int, head: int = 0) -> None:
        """Make a batch visible; ``head`` is a counter value carried to the next batch."""
        row = self.spark.createDataFrame([(int(batch_id), int(head))], _COMMIT_SCHEMA)
        earlier = [p for p in listed(self.spark, f"{self.path}/commits") if "/commit=" in p]
        target = f"{self.path}/commits/commit={int(batch_id)}"
        fold = len(earlier) >= FOLD
        if fold:
            # The batch's own row may be there already, from a commit that was cut short.
            row = row.unionByName(self.commits().where(F.col("batch_id") != int(batch_id)))
        row.coalesce(1).write.mode("overwrite").parquet(target)
        if fold:
            # The new file is complete by now; readers take equal rows of two files as one.
            for path in earlier:
                if path.rsplit("/", 1)[-1] != f"commit={int(batch_id)}":
                    removed(self.spark, path)

    def commits(self) -> DataFrame:
        try:
            return (
                self.spark.read.schema(_COMMIT_SCHEMA)
                .option("recursiveFileLookup", "true")
                .parquet(f"{self.path}/commits")
                .distinct()
            )
        except AnalysisException as error:
            if not _missing(error):
                raise
            return self.spark.createDataFrame([], _COMMIT_SCHEMA)

    def has(self, batch_id: int) -> bool:
        return not self.commits().where(F.col("batch_id") == int(batch_id)).isEmpty()

    def head(self) -> int:
        """The largest counter value of any committed batch, 0 when there is none."""
        return self.commits().agg(F.coalesce(F.max("head"), F.lit(0))).first()[0]

    def read(self) -> DataFrame:
        """All committed batches, with ``batch_id``; unread batches are pruned by directory."""
        schema = self.schema
        if isinstance(schema, str):
            schema = self.spark.createDataFrame([], schema).schema
        full = StructType([*schema.fields, StructField("batch_id", LongType())])
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.path}/data")
        except AnalysisException as error:
            if not _missing(error):
                raise
            return self.spark.createDataFrame([], full)
        return rows.join(self.commits().select("batch_id"), "batch_id", "left_semi").select(
            *full.fieldNames()
        )
