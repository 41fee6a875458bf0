"""Token ids as flat binary files, with 64-bit offsets, and their reading.

Layout of a data set folder: for each part ``part-NNNNN.ids`` (ids of all its documents, unsigned
little-endian, 16 bits where the vocabulary allows and else 32), ``part-NNNNN.off`` (documents + 1
unsigned 64-bit offsets in ids) and ``part-NNNNN.doc`` (64-bit document ids). Parts follow one
another in ascending document order, and so do the documents of a part. The manifest has one row a
part; a part's place in the whole is the prefix sum of the parts before it.

Documents are range-partitioned by id, once, and each partition writes its part: text is moved once
and ids never. A part is written under a name of its own attempt and then renamed, so a repeated or
speculative task replaces it by the same bytes. Files go to the shared folder through Arrow's file
systems (local paths, HDFS, S3, GCS). Local files are memory-mapped when read.

Edge cases: a null text is empty and has the end id alone. Equal or repeated ids keep all rows,
ordered by text. A null id comes first. An empty table writes no part and reads as no row.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallylog.llm.common import column_lists
from tallylog.llm.tokens import default_tokenizer, encoder
from tallylog.session import checkpointed, shared_folder

#: Stands for a null document id in the .doc files.
NO_ID = -(1 << 63)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def _replace(fs: pafs.FileSystem, path: str, parts: list, attempt: int) -> None:
    with fs.open_output_stream(f"{path}.{attempt}.tmp") as out:
        for part in parts:
            out.write(part)
    fs.move(f"{path}.{attempt}.tmp", path)


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    path: str | None = None,
    end_id: int = 1,
    dtype: str = "<u2",
) -> DataFrame:
    """Write all documents; returns the manifest (part, uri, docs, tokens, base), one row a part."""
    spark = docs.sparkSession
    path = path or default_tokenizer()
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    top = np.iinfo(np.dtype(dtype)).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = _open(folder)
        name, lengths, numbers = f"{root}/part-{part:05d}", [], []
        # Ids are streamed to the file; only lengths and document ids are held.
        out = None
        for batch in batches:
            doc_ids, texts = column_lists(batch, ["doc_id", "text"])
            for doc, ids in zip(doc_ids, encoder(path).encode(texts)):
                ids = np.append(ids, np.uint32(end_id))
                if int(ids.max()) > top:
                    raise ValueError(f"id {ids.max()} does not fit {dtype}")
                out = out or fs.open_output_stream(f"{name}.ids.{attempt}.tmp")
                out.write(ids.astype(dtype).tobytes())
                lengths.append(len(ids))
                numbers.append(NO_ID if doc is None else doc)
        if out is None:
            return
        out.close()
        fs.move(f"{name}.ids.{attempt}.tmp", f"{name}.ids")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        _replace(fs, f"{name}.off", [offsets.tobytes()], attempt)
        _replace(fs, f"{name}.doc", [np.array(numbers, "<i8").tobytes()], attempt)
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "uri": f"{folder}/part-{part:05d}", "docs": len(lengths),
              "tokens": int(offsets[-1])}]
        )

    written = checkpointed(
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "part bigint, uri string, docs bigint, tokens bigint")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _array(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read as a whole part."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.dtype(dtype), "r")
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_tokens(manifest: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*column_lists(batch, ["uri", "base"])):
                ids, numbers = _array(f"{uri}.ids", dtype), _array(f"{uri}.doc", "<i8")
                offsets = _array(f"{uri}.off", "<u8").astype(np.int64)
                sums = [
                    zlib.crc32(ids[a:b].astype("<u4").tobytes())
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers, pa.int64(), mask=np.asarray(numbers) == NO_ID),
                        pa.array(offsets[:-1] + base, pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "uri", "base").repartition(parts, "part").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the documents' ids and read the files back."""
    return read_tokens(write_tokens(docs, path=path, end_id=end_id))
