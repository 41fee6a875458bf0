"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Words are counted over all documents. Two words are near if one inserted, deleted or replaced code
point turns one into the other: their common prefix and common suffix together reach the longer
length less one. Both lengths are read from code-point matrices, padded on the right for prefixes
and on the left for suffixes, for all pairs of two blocks of words at once.

Which blocks meet. Let m be the longer length less one and k = m // 2 + 1. Near words share their
first k code points or their last m - k + 1. So a word of length L goes to the class of longer
length L and, as the shorter one, to that of L + 1, in each once by its first and once by its last
code points; only words of one class and key are compared. A pair with a common prefix of at least k
is put out by its prefix key alone, so no pair counts twice. Keys of up to ``TILE`` words are
compared where the key's hash puts them, many keys in one task. A larger key is cut into blocks of
that size, and each pair of blocks is a unit of its own, so one key with most of all words becomes
many tasks of bounded size.

A task puts out one row a word (near words seen, best of them), not pairs. Forms point at words of at
least ``RATIO`` times the occurrences, so chains are short; roots follow by doubling.

Edge cases: null and empty texts have no words. A null id counts as an empty one where a run's code
point is chosen. Rows that repeat an id or a text count again. Words without near words have n_near
0, no form and themselves as root. Of near words of equal n the first in code-point order is the
form. Extra columns are not read. Without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallylog.llm.common import column_lists
from tallylog.session import checkpointed

#: Words of at least so many code points and occurrences; a form has at least so many times n.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: One run in so many loses a code point.
DAMAGED = 199
#: Words of a block; larger keys are cut into blocks.
TILE = 1024
#: Counted words that a task holds before it hands them on.
HELD = 200_000

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text with their numbers, after the planned damage."""
    # Lower-casing bytes changes A-Z alone.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    counts = Counter(_RUNS.findall(lowered))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    damaged = [r for r in counts if zlib.crc32(r.encode(), start) % DAMAGED == 0]
    # All are taken out first: what one leaves may be another, and no run is damaged twice.
    for run, times in [(r, counts.pop(r)) for r in damaged]:
        at = zlib.crc32(run.encode(), start) % len(run)
        counts[run[:at] + run[at + 1 :]] += times
    return counts


def count_words(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(*column_lists(batch, ["doc_id", "text"])):
                if not text:
                    continue
                for word, n in words_of(doc_id, text).items():
                    if len(word) >= length:
                        held[word] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return (
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)
    )


def code_points(words: list[str], width: int, left: bool) -> np.ndarray:
    """Words as rows of code points, padded with zeros on the left or on the right."""
    pad = str.rjust if left else str.ljust
    every = "".join(pad(w, width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(every, "<u4").reshape(len(words), width)


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of ``a`` with each row of ``b``."""
    length = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones(length.shape, bool)
    for column in range(a.shape[1]):
        alive &= a[:, column, None] == b[None, :, column]
        if not alive.any():
            break
        length += alive
    return length


def near_in_blocks(a: list[str], b: list[str], longer: int, by_prefix: bool) -> np.ndarray:
    """Which words of block ``a`` are near which of block ``b``, as far as this kind of key tells.

    ``longer`` is the length of the longer word of each pair; pairs without one of that length, and
    equal words, are not near. Prefix keys tell the pairs whose common prefix reaches the key,
    suffix keys all others.
    """
    lengths = [np.array([len(w) for w in words]) for words in (a, b)]
    prefix = common_lengths(*(code_points(w, longer, False) for w in (a, b)))
    suffix = common_lengths(*(code_points(w, longer, True)[:, ::-1] for w in (a, b)))
    # Padding is alike in both only where both are the shorter length; such pairs are left out.
    near = (prefix + suffix >= longer - 1) & (np.maximum.outer(*lengths) == longer)
    near &= ~((prefix >= longer) & np.equal.outer(*lengths))
    reaches = prefix >= (longer - 1) // 2 + 1
    return near & (reaches if by_prefix else ~reaches)


class _Best:
    """For each word of a block the number of near words and the best of them."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        # Place of each word when the most frequent come first, then code-point order.
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.rank, self.order = np.empty(len(words), np.int64), np.array(order)
        self.rank[order] = np.arange(len(words))

    def rows(self, seen_by: list[str], near: np.ndarray) -> Iterator[tuple]:
        """(word, near words, n and name of the best) of the words ``seen_by`` that see this block."""
        some = np.flatnonzero(near.any(axis=1))
        ranks = np.where(near[some], self.rank[None, :], len(self.words))
        best = self.order[ranks.min(axis=1)]
        for i, number, one in zip(some, near[some].sum(axis=1), best):
            yield seen_by[i], int(number), int(self.n[one]), self.words[one]


def _keyed(words: DataFrame) -> DataFrame:
    """Words under each of their keys: longer length, kind and hash of the shared code points."""
    length = F.char_length("word")
    placed = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
    k = F.expr("(longer - 1) div 2 + 1")
    by_prefix = placed.withColumn("by_prefix", F.lit(True)).withColumn(
        "shared", F.substring("word", F.lit(1), k))
    by_suffix = placed.withColumn("by_prefix", F.lit(False)).withColumn(
        "shared", F.expr("right(word, longer - 1 - ((longer - 1) div 2 + 1) + 1)"))
    return by_prefix.unionByName(by_suffix).select(
        "word", "n", "longer", "by_prefix",
        F.xxhash64("longer", "by_prefix", "shared").alias("key"))


_SEEN = "word string, n_near bigint, form_n bigint, form string"


def _seen_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types)], ["word", "n_near", "form_n", "form"])


def _within_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within the small keys; rows come sorted by key, so a key is one run of rows."""

    def compared(words: list[str], n: list[int], longer: int, by_prefix: bool) -> Iterator[tuple]:
        if len(words) > 1 and max(map(len, words)) == longer:
            near = near_in_blocks(words, words, longer, by_prefix)
            if near.any():
                yield from _Best(words, np.array(n)).rows(words, near)

    names = ["key", "longer", "by_prefix", "word", "n"]
    held: list[list] = [[] for _ in names]
    for batch in batches:
        now = [h + c for h, c in zip(held, column_lists(batch, names))]
        keys = np.array(now[0], np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()] if len(keys) else [0]
        out = []
        for start, end in zip(cuts, cuts[1:]):
            out += compared(now[3][start:end], now[4][start:end], now[1][start], now[2][start])
        yield _seen_rows(out)
        held = [c[cuts[-1] :] for c in now]
    if held[0]:
        yield _seen_rows(list(compared(held[3], held[4], held[1][0], held[2][0])))


def _between_blocks(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Near words of two blocks of one large key, or within one block."""
    _, first, second, longer, by_prefix = key
    one = frame[frame["block"] == first]
    two = frame[frame["block"] == second]
    a, b = one["word"].tolist(), two["word"].tolist()
    rows: list[tuple] = []
    if a and b:
        near = near_in_blocks(a, b, int(longer), bool(by_prefix))
        rows += _Best(b, two["n"].to_numpy()).rows(a, near)
        if first != second:
            rows += _Best(a, one["n"].to_numpy()).rows(b, near.T)
    return pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n, all distinct) that have near words.

    ``form`` is the near word of the largest n, the first in code-point order of several.
    """
    keyed = _keyed(words)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = checkpointed(keyed.join(sizes, "key"))
    small = (
        placed.where(F.col("size") <= TILE).drop("size")
        .repartition("key").sortWithinPartitions("key").mapInArrow(_within_keys, _SEEN)
    )
    # Blocks are dealt by a hash of the word, so they stay near TILE words each.
    blocks = F.ceil(F.col("size") / TILE)
    large = placed.where(F.col("size") > TILE).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks")))
    paired = large.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)"))).select(
        "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "longer", "by_prefix", "block", "word", "n")
    between = paired.groupBy("key", "first", "second", "longer", "by_prefix").applyInPandas(
        _between_blocks, _SEEN)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return (
        small.unionByName(between).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): the end of each chain of forms, by doubling.

    A form has at least ``RATIO`` times its word's n, so a chain has a logarithmic length in the
    corpus, and the number of rounds is the logarithm of that.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpointed(now.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: n, its near words, its form (if frequent enough) and the root of that."""
    words = checkpointed(count_words(docs))
    joined = words.join(near_words(words), "word", "left")
    enough = F.col("form_n") >= RATIO * F.col("n")
    found = checkpointed(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
    ))
    return (
        found.join(roots(found.where("form is not null")), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
