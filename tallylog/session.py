"""Session settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Every timestamp column is TIMESTAMP_NTZ holding UTC, so the session zone must be UTC
#: wherever a zoned text or an epoch number is converted. Repeated JSON keys keep the last value.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Runtime re-planning; defaults in current Spark, stated so that a session that turned them
#: off is put right before a large job.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, as an archive.

    Spark serves the archive from the driver, so workers need neither the driver's working folder
    nor an installed copy.
    """
    context = spark.sparkContext
    if getattr(context, "_tallylog_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallylog-package-"), "tallylog.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._tallylog_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session, give its workers the package, return it."""
    ship_package(spark)
    for key, value in {**REQUIRED_CONF, **ADAPTIVE_CONF}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(cores: str = "8", name: str = "tallylog") -> SparkSession:
    """A local session for tests and the bench; on a cluster use ``configure`` instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        # Rows here are cheap to move and dear to parse, so small shuffles stay on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it
    unset: a fresh folder is then made (and remembered in the session, so one run uses one folder).
    On a cluster a folder of the driver's machine would not reach the executors, so that is refused.
    """
    for key in ("spark.checkpoint.dir", "spark.tallylog.folder"):
        folder = spark.conf.get(key, None)
        if folder:
            break
    else:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallylog-")
        spark.conf.set("spark.tallylog.folder", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Checkpoints made inside ``released_checkpoints``, or None outside of it.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


#: The largest size, in bytes, that a checkpointed table is held to be.
MOST_BYTES = (1 << 63) - 1


def _bounded(df: DataFrame) -> DataFrame:
    """A checkpointed DataFrame whose estimated size is at most ``MOST_BYTES``, all else as it is.

    Spark takes a join for as large as the product of its sides, and a checkpoint keeps that number.
    Where steps feed on each other's joins its digits multiply, up to megabytes a number, and the
    driver runs out of memory. A larger estimate is left out: Spark then puts ``MOST_BYTES`` in its
    place, which is beyond all thresholds too.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() <= MOST_BYTES:
        return df
    spark = df.sparkSession
    session, jvm = spark._jsparkSession, spark.sparkContext._jvm
    table = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(),
        plan.isStreaming(), plan.stream(),
        session, jvm.scala.Option.empty(), jvm.scala.Some(plan.constraints()),
    )
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, table), spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the reliable checkpoint folder and read it back from there.

    For narrow intermediate results that several later steps read: they are computed once, and a
    lost executor costs a re-read instead of a recomputation.
    """
    shared_folder(df.sparkSession)
    out = _bounded(df.checkpoint())
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


@contextmanager
def released_checkpoints():
    """Delete the checkpoints made in this block when it ends well, as after a committed batch.

    After an error they stay for the retry's reader to look at; whatever a job leaves can be
    removed with the folder, or by ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    token = _MADE.set([])
    try:
        yield
        for df in _MADE.get():
            context = df.sparkSession.sparkContext
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                path = context._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    finally:
        _MADE.reset(token)
