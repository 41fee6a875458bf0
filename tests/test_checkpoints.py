"""Checkpointed tables: their rows, and the sizes that Spark holds them to be."""

from pyspark.sql import functions as F

from tallylog.session import checkpointed, released_checkpoints

#: Spark's size of a table that it knows nothing of.
UNKNOWN = (1 << 63) - 1


def held_size(df):
    return df._jdf.queryExecution().analyzed().stats().sizeInBytes()


def doubled(rows):
    """Rows joined with themselves, as by a step that takes its input twice."""
    other = rows.withColumnRenamed("n", "m")
    return rows.join(other, "id").select("id", (F.col("n") + F.col("m")).alias("n"))


def test_estimates_do_not_multiply_over_steps(spark):
    rows = checkpointed(spark.range(20).withColumn("n", F.when(F.col("id") != 3, 1)))
    small = held_size(rows)
    for _ in range(6):
        rows = checkpointed(doubled(rows))
        assert held_size(rows) <= UNKNOWN
    assert small < held_size(rows) == UNKNOWN  # a small estimate stays as it was
    assert sorted(map(tuple, rows.collect())) == [(i, None if i == 3 else 64) for i in range(20)]
    assert rows.columns == ["id", "n"] and not rows.isStreaming
    # It can meet itself, and what it is known to hold is still known.
    assert rows.join(rows.select("id"), "id").count() == 20
    assert "isnotnull" in rows._jdf.queryExecution().analyzed().constraints().toString()


def test_bounded_checkpoints_are_released(spark):
    rows = spark.range(5).withColumn("n", F.lit(1))
    with released_checkpoints():
        for _ in range(4):
            rows = checkpointed(doubled(rows))
        file = rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(file)
        assert rows.count() == 5 and path.getFileSystem(conf).exists(path)
    assert not path.getFileSystem(conf).exists(path)
