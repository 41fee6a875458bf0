"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

A text becomes its hashed token unigrams and bigrams, each with the value log2(1 + count), scaled
to a vector of length 1. Tokens are runs of word characters, case kept, and runs of other non-space
characters, so that ``word%%%`` and ``WORD!!`` share the token of their tail; a token that comes
again at once, or after one other, adds to one feature of repetition.

Training reads a bounded sample of the labelled documents (``sample`` rows, chosen by a hash of the
id) in one task; it is the only bounded part. Scoring is a sparse dot product per document over
the whole text, in Arrow batches, with the weights as a broadcast of 2^``bits`` numbers.

Edge cases: null and empty texts have no feature and get the score of the bias alone. Rows with a
null label are not learned from; several labels of one document are averaged. Without any labelled
row every weight is 0 and every score 0.5. Repeated rows are scored each. Other columns are kept by
``keep_good`` and never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallylog.llm.common import BoundedCache, column_lists, held_out

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class FtrlConfig:
    """``sample`` bounds the labelled rows read by the training task."""

    bits: int = 18
    sample: int = 6000
    epochs: int = 4
    alpha: float = 30.0
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.0


def _token_hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


_TOKENS = BoundedCache(_token_hash)


#: Stands for a bigram of a token and the same one, or with one token between: repetition.
_AGAIN = np.uint32(zlib.crc32(b"again"))


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their values, of length 1 as a vector."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    words = np.fromiter(map(_TOKENS.__getitem__, tokens), np.uint32, len(tokens))
    single = words * np.uint32(0x9E3779B1)
    pairs = words[:-1] * np.uint32(0x85EBCA77) + words[1:] * np.uint32(0xC2B2AE3D)
    again = np.count_nonzero(words[1:] == words[:-1]) + np.count_nonzero(words[2:] == words[:-2])
    every = np.concatenate([single, pairs, np.full(again, _AGAIN)]) >> np.uint32(32 - bits)
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    values = np.log2(1.0 + np.diff(np.append(first, len(every))))
    return every[first].astype(np.int64), values / np.sqrt(values @ values)


def score_features(at: np.ndarray, values: np.ndarray, weights: np.ndarray, bias: float) -> float:
    total = float(weights[at] @ values) + bias
    return 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, total))))


def train_rows(rows: list[tuple], config: FtrlConfig) -> tuple[np.ndarray, float]:
    """Weights and bias from (order, text, label) rows, learned one after another."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or "", r[2]))
    examples = [(features(text, config.bits), float(label)) for _, text, label in rows]
    z = np.zeros((1 << config.bits) + 1)
    n = np.zeros_like(z)
    bias = np.array([1 << config.bits])
    a, b, l1, l2 = config.alpha, config.beta, config.l1, config.l2

    def weights(i: np.ndarray) -> np.ndarray:
        # The bias is not shrunk.
        edge = np.where(i == bias[0], 0.0, l1)
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - edge, 0.0)
        return -shrunk / ((b + np.sqrt(n[i])) / a + l2)

    for _ in range(config.epochs):
        for (found, values), label in examples:
            at, x = np.concatenate([found, bias]), np.append(values, 1.0)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / a
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(len(z)))
    return every[:-1].astype(np.float32), float(every[-1])


def train_quality(docs: DataFrame, labels: DataFrame, config: FtrlConfig = FtrlConfig()):
    """(weights, bias) learned from the labelled documents that are not held out."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit("quality"))
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("_label"))
    )
    # A hash threshold keeps about ``sample`` labels, so the table joined below is bounded.
    total = marked.count()
    share = min(1.0, config.sample / max(1, total))
    bound = int(-(1 << 63) + share * ((1 << 64) - 1))
    chosen = marked.where(order <= min(bound, (1 << 63) - 1))
    # Of rows that repeat an id one teaches, so the training task's rows are bounded as the labels are.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "_label").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("_row"))
        .select(order.alias("_order"), F.col("_row.text").alias("text"), F.col("_label"))
        .repartition(1)
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple] = []
        for batch in batches:
            examples += zip(*column_lists(batch, ["_order", "text", "_label"]))
        weights, bias = train_rows(examples, config)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(at, -1), pa.int64()),
                pa.array(np.append(weights[at].astype(np.float64), bias), pa.float64()),
            ],
            ["feature", "weight"],
        )

    weights, bias = np.zeros(1 << config.bits, np.float32), 0.0
    for feature, weight in rows.mapInArrow(learn, "feature bigint, weight double").collect():
        if feature < 0:
            bias = weight
        else:
            weights[feature] = weight
    return spark.sparkContext.broadcast(weights), bias


def quality_score(model, text: str | Column = "text", config: FtrlConfig = FtrlConfig()) -> Column:
    """Score column (0 to 1) of a text column."""
    weights, bias = model
    bits = config.bits

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = weights.value
        for texts in batches:
            out = np.empty(len(texts))
            for i, one in enumerate(texts):
                out[i] = score_features(*features(one, bits), w, bias)
            yield pd.Series(out)

    return score(F.col(text) if isinstance(text, str) else text)


#: Documents under this score are rejected.
GOOD = 0.3


def score_documents(docs: DataFrame, model, config: FtrlConfig = FtrlConfig()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``GOOD`` on) of every row."""
    scored = docs.select(
        "doc_id", held_out().alias("held_out"), quality_score(model, "text", config).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def keep_good(docs: DataFrame, model, config: FtrlConfig = FtrlConfig()) -> DataFrame:
    """The rows with a score of at least ``GOOD``, all columns as they are."""
    return docs.where(quality_score(model, "text", config) >= GOOD)
