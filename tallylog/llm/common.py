"""Settings and small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallylog.session import configure, shared_folder

#: Documents differ in length by a factor of 10 000, so Arrow batches are bounded in rows and bytes.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

_MASK = (1 << 64) - 1


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library, bounded batches and a checkpoint folder."""
    configure(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    shared_folder(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from; a null id counts as ''."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None))
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


class BoundedCache(dict):
    """A look-up that computes missing values and starts anew when it holds ``limit`` entries.

    It changes speed only: a value is a pure function of its key.
    """

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


#: 64-bit hash of a word given as bytes; one per Python worker.
WORD_HASHES = BoundedCache(xxhash.xxh3_64_intdigest, 150_000)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers in which every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words.

    Fewer words make one shingle of the whole sequence; no words make the empty set. The hash of a
    run weighs each word's hash with an odd constant of its place, so order matters.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    hashes, k = word_hashes(words), min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & _MASK)
        total += mixed64(hashes[i : n - k + 1 + i] + np.uint64(i)) * odd
    return np.unique(mixed64(total))


def ascii_words(text: str | bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and U+0009 to U+000D. Null has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.lower().split()


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(a) == 0 or len(b) == 0:
        return 0, len(a) + len(b)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return both, len(a) + len(b) - both


def column_lists(batch, names: Iterable[str]) -> list[list]:
    """Columns of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]
