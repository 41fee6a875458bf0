"""Packing documents into sequences of a fixed number of tokens.

A document's ids are cut into full sequences and a rest. Rests are packed by first-fit decreasing,
where a tournament tree over the bins' free places finds the first bin that fits in logarithmic
time. That runs independently in groups of about ``group_rows`` rests, dealt at random by a hash of
document and start, so no document and no source gathers in one task; each group wastes at most its
last bins. Sequence numbers are gapless: a group's first number is the prefix sum of the bins of the
groups before it, taken over one row a group.

Ids stay inside the encoding task: pieces carry their check sum, so what moves is some 50 bytes a
piece.

Edge cases: a null text is empty and has the end id alone; an empty table gives no piece. Rows that
repeat a document are packed each. Ties in length are ordered by document, start and check sum. A
null id is allowed. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallylog.llm.common import column_lists
from tallylog.llm.tokens import default_tokenizer, encoder
from tallylog.session import checkpointed

#: Tokens of a sequence.
CAPACITY = 4096
#: Rests packed together in one task; a documented layout bound that leaves out nothing.
GROUP_ROWS = 50_000


class FirstFit:
    """Bins of equal capacity; ``put`` finds the first bin with enough room.

    The tree's leaves are the free places of the bins, unopened ones being empty, and each inner
    node has the larger of its children: going left whenever the left child suffices finds the
    first bin. The tree doubles when its bins run out.
    """

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1
        self.tree = [capacity, capacity]

    def _grow(self) -> None:
        old, size = self.tree[self.size :], self.size * 2
        tree = [0] * size + old + [self.capacity] * self.size
        for i in range(size - 1, 0, -1):
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        self.tree, self.size = tree, size

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of at most the capacity."""
        while self.tree[1] < length:
            self._grow()
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < length:
                at += 1
        place = at - self.size, self.capacity - tree[at]
        tree[at] -= length
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left > right else right
        return place


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; equal lengths are placed in the given order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fit = FirstFit(capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], offsets[i] = fit.put(int(lengths[i]))
    return bins, offsets


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def token_pieces(
    docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = CAPACITY
) -> DataFrame:
    """The pieces of every document: its full sequences and its rest, with their check sums."""
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_in, texts = column_lists(batch, ["doc_id", "text"])
            rows: list[tuple] = []
            for doc, ids in zip(ids_in, encoder(path).encode(texts)):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], names
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, _PIECES)


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    spark = pieces.sparkSession
    groups = max(1, -(-pieces.count() // group_rows))
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit("pack")), F.lit(groups))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(np.int64), capacity)
        return group.assign(bin=bins, offset=offsets)

    packed = checkpointed(
        pieces.withColumn("group_no", spread)
        .groupBy("group_no")
        .applyInPandas(pack, f"{_PIECES}, group_no bigint, bin bigint, offset bigint")
    )
    sizes = packed.groupBy("group_no").agg((F.max("bin") + 1).alias("_bins"))
    # One row a group: a millionth of the documents.
    before = Window.orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("group_no", F.coalesce(F.sum("_bins").over(before), F.lit(0)).alias("_base"))
    return packed.join(bases, "group_no").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_base") + F.col("bin")).alias("sequence_id"), "offset",
    )


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Encode, cut and pack all documents; one row per piece."""
    pieces = checkpointed(token_pieces(docs, path, end_id, capacity))
    return pack_pieces(pieces, capacity, group_rows)
