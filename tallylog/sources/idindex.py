"""An index of event ids whose look-ups read a bounded number of files.

Ids lie in runs, cut into buckets by their hash. A batch writes a run of its own; every ``FAN``
batches the last ``FAN`` runs of a level become one run of the next. Which runs are live follows from
the number of batches alone, as its digits in base ``FAN``, so no list of runs is kept and there are
at most (FAN - 1) runs a level.

A Bloom filter for each bucket says which ids of a batch may be stored. It has a fixed size, is
rewritten as a whole with each batch, and is joined on parts of 32 768 bits, so neither it nor the
probes pass through the driver. Only buckets with a hit are read, and those ids are compared
exactly: a filter that is too small for its ids costs reads, never a wrong answer.

A run and a filter are visible once a later batch asks for them, so a failed batch rewrites both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallylog.session import checkpointed
from tallylog.sources.tables import listed, removed

#: Runs of a level that are merged into one of the next.
FAN = 8
#: Bits of a filter part, as Spark's bitmaps have.
PART_BITS = 32_768
#: Bits that each id sets.
PROBES = 4

_BLOOM = "bucket int, part int, bits binary"


def live_runs(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, first batch) of the runs that hold the batches 0 to ``batches`` - 1."""
    level, size, found = 0, 1, []
    while batches >= size:
        size, level = size * fan, level + 1
    start = 0
    for step in range(level - 1, -1, -1):
        size = fan**step
        while batches - start >= size:
            found.append((step, start))
            start += size
    return found


@dataclass(frozen=True)
class IdIndex:
    spark: SparkSession
    path: str
    #: Fixed when the index is made. The defaults fit about 3 million ids at one false hit in 1000;
    #: a large table takes more buckets or parts.
    buckets: int = 64
    parts: int = 16
    fan: int = FAN

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int")

    def _probes(self, ids: DataFrame) -> DataFrame:
        """(event_id, bucket, part, position): the bits of each id."""
        bits = self.parts * PART_BITS
        places = F.array(*[
            F.pmod(F.xxhash64("event_id", F.lit(f"bloom-{i}")), F.lit(bits)) for i in range(PROBES)])
        return ids.select("event_id", self._bucket().alias("bucket"), F.explode(F.array_distinct(places)).alias("at")).select(
            "event_id", "bucket", F.expr(f"cast(at div {PART_BITS} as int)").alias("part"),
            (F.col("at") % PART_BITS).alias("position"))

    def _bloom(self, batches: int) -> DataFrame | None:
        """The filter over the first ``batches`` batches; None if there is none yet."""
        if not batches:
            return None
        return self.spark.read.schema(_BLOOM).parquet(f"{self.path}/bloom/upto={batches}")

    def _run(self, level: int, start: int) -> str:
        return f"{self.path}/runs/level={level}-start={start}"

    def _read_run(self, level: int, start: int, hit: list[int]) -> DataFrame | None:
        """The ids of a run in the given buckets; None if it has none there."""
        wanted = {f"bucket={bucket}" for bucket in hit}
        paths = [p for p in listed(self.spark, self._run(level, start)) if p.rsplit("/", 1)[-1] in wanted]
        return self.spark.read.schema("event_id string").parquet(*paths) if paths else None

    def possible(self, ids: DataFrame, batches: int) -> DataFrame:
        """(event_id, bucket) of the ids, all distinct, that the filter does not rule out."""
        bloom = self._bloom(batches)
        if bloom is None:
            return ids.select("event_id", self._bucket().alias("bucket")).limit(0)
        byte = "cast(conv(hex(substring(bits, cast(position div 8 + 1 as int), 1)), 16, 10) as int)"
        probes = self._probes(ids)
        held = probes.join(bloom, ["bucket", "part"]).where(
            F.expr(f"shiftright({byte}, cast(position % 8 as int)) % 2 = 1"))
        asked = probes.groupBy("event_id", "bucket").agg(F.count(F.lit(1)).alias("asked"))
        set_ = held.groupBy("event_id").agg(F.count(F.lit(1)).alias("set"))
        return asked.join(set_, "event_id").where("asked = set").select("event_id", "bucket")

    def known(self, ids: DataFrame, batches: int) -> DataFrame:
        """Those of the distinct ``ids`` (event_id) that the first ``batches`` batches hold."""
        possible = checkpointed(self.possible(ids, batches))
        # At most one number a bucket.
        hit = [row[0] for row in possible.select("bucket").distinct().collect()]
        found = None
        for run in live_runs(batches, self.fan) if hit else ():
            rows = self._read_run(*run, hit)
            if rows is not None:
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return possible.select("event_id").limit(0)
        return possible.select("event_id").join(found, "event_id", "left_semi")

    def write(self, ids: DataFrame, batches: int) -> None:
        """Add the new ids (event_id) of batch number ``batches``; a repeat replaces what it wrote."""
        keyed = ids.select("event_id", self._bucket().alias("bucket"))
        self._write_run(keyed, 0, batches)
        # The run just written counts, so a full level is folded at once, and that may fill the next.
        level, size = 0, self.fan
        while (batches + 1) % size == 0:
            level, start = level + 1, batches + 1 - size
            parts = [(level - 1, start + i * size // self.fan) for i in range(self.fan)]
            merged = None
            for part in parts:
                rows = self._read_run(*part, list(range(self.buckets)))
                if rows is not None:
                    merged = rows if merged is None else merged.unionByName(rows)
            if merged is not None:
                self._write_run(merged.select("event_id", self._bucket().alias("bucket")), level, start)
            size *= self.fan
        fresh = self._probes(ids).groupBy("bucket", "part").agg(
            F.bitmap_construct_agg("position").alias("bits"))
        before = self._bloom(batches)
        if before is not None:
            fresh = fresh.unionByName(before).groupBy("bucket", "part").agg(
                F.bitmap_or_agg("bits").alias("bits"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/bloom/upto={batches + 1}")

    def _write_run(self, keyed: DataFrame, level: int, start: int) -> None:
        # One file a bucket, unless a bucket is so large that adaptive execution splits it.
        (
            keyed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "event_id")
            .write.mode("overwrite").partitionBy("bucket").option("compression", "zstd")
            .parquet(self._run(level, start))
        )

    def tidy(self, batches: int) -> None:
        """Delete what no batch after the first ``batches``, all committed, will read."""
        removed(self.spark, f"{self.path}/bloom/upto={batches - 1}")
        level, size = 0, self.fan
        while batches % size == 0:
            for i in range(self.fan):
                removed(self.spark, self._run(level, batches - size + i * size // self.fan))
            level, size = level + 1, size * self.fan
