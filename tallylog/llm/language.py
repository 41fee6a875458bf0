"""Language ID by rank-order profiles of character n-grams.

A profile is the list of a language's ``depth`` most frequent n-grams of 1 to 3 letters, counted
over all training documents: counts are summed inside each task, then by a grouped sum, and ranked
per language with a group-limited window. A document is ranked the same way and compared with each
profile by the out-of-place distance: the sum of the rank differences of its n-grams, ``depth`` for
an n-gram that a profile lacks. The smallest distance wins; ties go to the first language name.

Letters are lower-cased; everything else is a word gap. N-grams may begin or end with one gap but
do not span two words. The score is 1 - distance / largest possible distance.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text when
nothing could be learned. Rows with a null language or text teach nothing. Texts shorter than a
profile are compared on the n-grams they have. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallylog.llm.common import column_lists, held_out

DEPTH = 300
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str | None) -> np.ndarray:
    """The n-grams of a text, 21 bits a letter; a gap is 0 and shorter n-grams have high zeros.

    Unigrams, bigrams and trigrams are told apart by two bits on top of their last letter's place.
    """
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[np.minimum(points, 0x10FFFF)], points, 0)
    # One gap between words, one before the first and one after the last.
    keep = points != 0
    if not keep.any():
        return np.empty(0, np.uint64)
    keep[1:] |= points[:-1] != 0
    c = np.concatenate([[0], points[keep], [0]]).astype(np.uint64)
    if c[1] == 0:
        c = c[1:]
    if c[-2] == 0:
        c = c[:-1]
    one = c[c != 0]
    two = ((c[:-1] << np.uint64(21)) | c[1:])[(c[:-1] != 0) | (c[1:] != 0)]
    three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[c[1:-1] != 0]
    return np.concatenate([one, two | np.uint64(1 << 63), three])


def ranked(text: str | None, depth: int) -> np.ndarray:
    """The ``depth`` most frequent n-grams of a text, most frequent first, ties by code."""
    codes = gram_codes(text)
    if len(codes) == 0:
        return codes
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(first, len(codes)))
    order = np.argsort(-counts, kind="stable")[:depth]
    return codes[first[order]]


class Profiles:
    """Ranks of the n-grams of all languages, as sorted codes and one rank column a language."""

    def __init__(self, rows: list[tuple[str, int, int]], depth: int):
        self.depth = depth
        self.languages = sorted({r[0] for r in rows})
        codes = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        self.codes = np.unique(codes)
        self.ranks = np.full((len(self.codes), len(self.languages)), -1, np.int64)
        for (language, _, rank), code in zip(rows, codes):
            at = np.searchsorted(self.codes, code)
            self.ranks[at, self.languages.index(language)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(text, self.depth)
        if len(grams) == 0 or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, grams)
        at[at == len(self.codes)] = 0
        ranks = np.where((self.codes[at] == grams)[:, None], self.ranks[at], -1)
        places = np.arange(len(grams))[:, None]
        distance = np.where(ranks < 0, self.depth, np.abs(ranks - places)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (len(grams) * self.depth)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


#: Distinct n-grams of one language that a task holds before it passes them on.
HELD = 500_000
#: N-grams that are gathered before they are counted: 16 MB, whatever the batch.
FOLDED = 2_000_000


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): partial n-gram counts, one row per task at least, to be summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(language: str) -> pa.RecordBatch:
            codes, counts = held.pop(language)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([language] * len(codes), pa.string()),
                    pa.array(codes.view(np.int64), pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                ["lang", "gram", "n"],
            )

        found: dict[str, list] = {}
        size = 0

        def fold() -> None:
            for language, parts in found.items():
                pair = np.unique(np.concatenate(parts), return_counts=True)
                held[language] = _merged([held[language], pair]) if language in held else pair
            found.clear()

        for batch in batches:
            for language, text in zip(*column_lists(batch, ["lang", "text"])):
                codes = gram_codes(text)
                if len(codes):
                    found.setdefault(language, []).append(codes)
                    size += len(codes)
                if size > FOLDED:
                    fold()
                    size = 0
            for language in [x for x in held if len(held[x][0]) > HELD]:
                yield rows(language)
        fold()
        for language in list(held):
            yield rows(language)

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return known.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")


def learn_profiles(docs: DataFrame, depth: int = DEPTH) -> Profiles:
    """Profiles of all languages of ``docs`` (columns text, lang), from all its rows.

    What reaches the driver is ``depth`` rows a language, and languages are few.
    """
    totals = count_grams(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Ties in unsigned order, as in a document's ranks; flipping the sign bit makes it the signed one.
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), unsigned)
    top = totals.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= depth)
    rows = top.select("lang", "gram", F.col("rank") - 1).collect()
    return Profiles([tuple(r) for r in rows], depth)


def language_of(profiles: Profiles, text: str | Column = "text") -> Column:
    """Struct (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [profiles.predict(one) for one in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(F.col(text) if isinstance(text, str) else text)


def predict_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    return docs.select(
        "doc_id", held_out().alias("held_out"), language_of(profiles).alias("_found")
    ).select("doc_id", "held_out", "_found.lang_pred", "_found.score")


def keep_known(docs: DataFrame, profiles: Profiles, least: float = 0.1) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, columns as they are."""
    found = language_of(profiles)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
