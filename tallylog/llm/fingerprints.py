"""Document fingerprints: threshold-scaled sketches of word shingles.

The sketch of a document holds every hash of its five-word shingles that lies below a fixed
fraction (1/``SCALE``) of the 64-bit range. The threshold is the same for all documents, so a
sketch grows with its document, the sketch of a union is the union of the sketches, and the share of
one sketch found in another estimates containment, however unequal the two are. When no hash lies
below the threshold, the smallest hash is kept, so only a text without words has an empty sketch; the
union rule still holds (hashes below the threshold, or else the smallest). Such a stand-in says
nothing about containment, which is then undefined (null): so it is for some 45 % of the texts of ten
words, and for 1 % of those of forty.

A fingerprint is the base64 text of the sorted hashes, 8 bytes each. Likeness is the estimated
Jaccard similarity: 1 for two empty sketches, 0 when one is empty.

``compare_neighbours`` needs the next document in id order. Documents are range-partitioned by id
once and read in order; each partition also puts out its first and its last text, and these few rows
(two texts a partition) are joined on the partition number to finish the last document of each.

Edge cases: null and empty texts have 0 characters and an empty fingerprint. Fewer than five words
make one shingle. Rows that repeat an id follow one another, ordered by text; a null id comes first.
A single document is its own next one. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallylog.llm.common import ascii_words, column_lists, jaccard, shingle_set
from tallylog.session import checkpointed

#: One hash in so many is kept.
SCALE = 8
SHINGLE = 5


def sketch(text: str | None, scale: int = SCALE, size: int = SHINGLE) -> np.ndarray:
    """Sorted kept hashes of a text."""
    hashes = shingle_set(ascii_words(text), size)
    kept = hashes[: np.searchsorted(hashes, np.uint64((1 << 64) // scale))]
    return kept if len(kept) else hashes[:1]


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two documents taken together."""
    both = np.union1d(a, b)
    kept = both[: np.searchsorted(both, np.uint64((1 << 64) // scale))]
    return kept if len(kept) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both, either = jaccard(a, b)
    return both / either


def sampled(hashes: np.ndarray, scale: int = SCALE) -> bool:
    """Whether a sketch holds hashes below the threshold and not a stand-in."""
    return len(hashes) > 0 and int(hashes[0]) < (1 << 64) // scale


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """Estimated share of the first document's shingles that the second one has; 1 for a text without
    words, None where the sketch is too small to tell."""
    if len(a) == 0:
        return 1.0
    return jaccard(a, b)[0] / len(a) if sampled(a, scale) else None


def as_text(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u8").tobytes()).decode("ascii")


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, scale: int = SCALE, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row: the operator itself, without any shuffle."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column_lists(batch, ["doc_id", "text"])
            prints = [as_text(sketch(text, scale, size)) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(prints, pa.string())],
                ["doc_id", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        take, "doc_id bigint, fingerprint string"
    )


#: What is written for each document: its sketch, which of its hashes the edited text keeps (a bit
#: each), the edited text's other hashes, and the sizes that likeness needs. Half of two sketches.
_COMPACT = (
    "doc_id bigint, n_chars bigint, sha binary, own binary, kept binary, added binary, "
    "next_both bigint, next_size bigint"
)
_COMPACT_TYPES = [pa.int64()] * 2 + [pa.binary()] * 4 + [pa.int64()] * 2
_EDGE = ", part bigint, first_text string, last_text string"
_EDGE_TYPES = [pa.int64(), pa.string(), pa.string()]
_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, contained_edited double, "
    "contained_next double"
)
_RESULT_TYPES = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 4


def _compared(doc, text: str, own: np.ndarray, following: str, next_one: np.ndarray) -> tuple:
    changed = edited_text(text, following)
    other = sketch(changed)
    kept = np.isin(own, other, assume_unique=True)
    return (
        doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(),
        own.astype("<u8").tobytes(), np.packbits(kept).tobytes(),
        np.setdiff1d(other, own, assume_unique=True).astype("<u8").tobytes(),
        jaccard(own, next_one)[0], len(next_one),
    )


def _expanded(doc, n_chars, sha, own, kept, added, next_both, next_size) -> tuple:
    own = np.frombuffer(own, "<u8")
    both = own[np.unpackbits(np.frombuffer(kept, np.uint8), count=len(own)).astype(bool)]
    other = np.sort(np.concatenate([both, np.frombuffer(added, "<u8")]))
    size = len(own)
    next_likeness = next_both / (size + next_size - next_both) if size + next_size else 1.0
    return (
        doc, n_chars, sha.hex(), as_text(own), as_text(other), likeness(own, other), next_likeness,
        containment(own, other), next_both / size if sampled(own) else None if size else 1.0,
    )


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last half of its characters replaced by the start of the next document
    in ascending id order; the last document is followed by the first.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), None, None
        types = _COMPACT_TYPES + _EDGE_TYPES
        for batch in batches:
            rows = []
            for doc, text in zip(*column_lists(batch, ["doc_id", "text"])):
                text = text or ""
                own = sketch(text)
                if held is None:
                    first = text
                else:
                    rows.append((*_compared(*held, text, own), None, None, None))
                held = doc, text, own
            yield _batch(rows, _COMPACT + _EDGE, types)
        if held is not None:
            doc, text, _ = held
            yield _batch([(doc, *[None] * 7, part, first, text)], _COMPACT + _EDGE, types)

    walked = checkpointed(
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(walk, _COMPACT + _EDGE)
    )
    edges = walked.where("part is not null").select("doc_id", "part", "first_text", "last_text")
    # Numbers only, one row a partition; the texts follow by a join.
    ring = Window.orderBy("part")
    order = edges.select("part").withColumn(
        "next_part", F.coalesce(F.lead("part").over(ring), F.min("part").over(
            ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    following = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    open_ends = edges.join(order, "part").join(following, "next_part").select(
        "doc_id", F.col("last_text").alias("text"), "next_text"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _expanded(*_compared(doc, text, sketch(text), following, sketch(following)))
                for doc, text, following in zip(
                    *column_lists(batch, ["doc_id", "text", "next_text"]))
            ]
            yield _batch(rows, _RESULT, _RESULT_TYPES)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_expanded(*row) for row in zip(*column_lists(batch, batch.schema.names))]
            yield _batch(rows, _RESULT, _RESULT_TYPES)

    compact = walked.where("part is null").drop("part", "first_text", "last_text")
    # One Python function a task: chained ones would each hold a worker.
    return compact.mapInArrow(expand, _RESULT).unionByName(open_ends.mapInArrow(finish, _RESULT))
