"""Embedding near-dedup by product quantisation over inverted lists, with exact cosine rerank.

Index. Unit vectors are put into the inverted list of their nearest coarse centroid; what is left,
the residual, is coded by the nearest codeword of each of ``SUBSPACES`` subspaces, and the length of
the coding error is kept. Centroids and codewords are fitted on at most ``SAMPLE`` vectors; every
vector is indexed.

Search. A pair of cosine >= c lies within d = sqrt(2 - 2c). A query therefore probes exactly the
lists that can hold such a neighbour: those whose cell border is within d of the query,
(|q-b|^2 - |q-a|^2) / 2|a-b| <= d for its own centroid a and the other b. In a list, distances come
from a table of the query residual against all codewords; a vector goes on to the rerank when its
table distance is at most d plus its coding error, so by the triangle inequality no neighbour is
lost. The rerank is the cosine in double precision on the original vectors.

Scale. Equal vectors of a label are one class with a count, so copies never meet. Lists are kept by
label; a list is cut into blocks and its queries into chunks of bounded size, and each (block, chunk)
is one group, so a hot label, list or vector is many tasks. A pair is looked at once. A group gives
one row per linked class: its number of links and its smallest partner reachable inside the group;
pairs are never put out.

Edge cases: a null label, a null or empty vector, one of zeros only and one with a null or non-finite
component links with nothing and is its own component. Vectors of different dimensions are not
compared. A repeated vec_id is several vectors; a null one links but numbers no component unless all
of its component is null (then null, kept). An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallylog.llm.components import components
from tallylog.session import checkpointed

COSINE = 0.98
#: Vectors that centroids and codewords are fitted on; a bound of the fit alone.
SAMPLE = 20_000
#: Most lists, which keep their length up to 64 million vectors of one dimension; a larger ``SAMPLE``
#: can place more.
LISTS = 4096
SUBSPACES, CODEWORDS = 8, 256
#: Index vectors of a block and query vectors of a chunk.
BLOCK, CHUNK = 2048, 2048
#: Room for rounding in the bounds of the search.
SLACK = 1e-3


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(1)[None, :]
    return np.concatenate([
        np.argmin(square - 2.0 * (x[at : at + 2048] @ centres.T), axis=1)
        for at in range(0, max(1, len(x)), 2048)
    ])


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread rows; an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(1))[:, None]


class Quantizer:
    """Coarse centroids and the codewords of the subspaces of residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _means(sample, lists)
        # Distances of all centroids, once: as many numbers as the square of the lists.
        square = (self.centres * self.centres).sum(1)
        apart = square[:, None] + square[None] - 2.0 * (self.centres @ self.centres.T)
        self.apart = np.sqrt(np.maximum(apart, 0.0))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        dim = sample.shape[1]
        self.edges = np.unique(np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int))
        self.words = [_means(rest[:, a:b], CODEWORDS) for a, b in zip(self.edges, self.edges[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the coding error of each row."""
        near = _nearest(x, self.centres)
        rest = x - self.centres[near]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        for i, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            codes[:, i] = _nearest(rest[:, a:b], self.words[i])
            rest[:, a:b] -= self.words[i][codes[:, i]]
        return near, codes, np.sqrt((rest * rest).sum(1))

    def probes(self, x: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray:
        """Rows by lists: whether a neighbour within ``reach`` can lie in the list."""
        square = (self.centres * self.centres).sum(1)[None, :] - 2.0 * (x @ self.centres.T)
        own = square[np.arange(len(x)), near]
        return square - own[:, None] <= 2.0 * self.apart[near] * (reach + SLACK)

    def table(self, x: np.ndarray, number: int) -> list[np.ndarray]:
        """Per subspace, the square distances of each row's residual in a list to all codewords."""
        rest = x - self.centres[number]
        parts = [rest[:, a:b] for a, b in zip(self.edges, self.edges[1:])]
        return [
            (p * p).sum(1)[:, None] + (w * w).sum(1)[None] - 2.0 * (p @ w.T)
            for p, w in zip(parts, self.words)
        ]


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Smallest value reachable from each of n nodes over the links (a, b)."""
    value = value.copy()
    while True:
        before = value.copy()
        low = np.minimum(value[a], value[b])
        np.minimum.at(value, a, low)
        np.minimum.at(value, b, low)
        if np.array_equal(before, value):
            return value


def _group_links(words: Quantizer, cosine: float):
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))

    def links(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(index) == 0 or len(queries) == 0:
            return pd.DataFrame({"cls": [], "links": [], "root": []}).astype("int64")
        number = int(key[1])
        x, y = unit(queries["embedding"]), unit(index["embedding"])
        codes = np.array([np.frombuffer(c, np.uint8) for c in index["codes"]])
        error = index["error"].to_numpy()
        one, two = queries["cls"].to_numpy(), index["cls"].to_numpy()
        here = (queries["list"] == number).to_numpy()
        found_a, found_b = [], []
        for start in range(0, len(x), 256):
            part = x[start : start + 256]
            tables = words.table(part, number)
            square = np.zeros((len(part), len(y)))
            for i, t in enumerate(tables):
                square += t[:, codes[:, i]]
            likely = np.sqrt(np.maximum(square, 0)) <= reach + error[None] + SLACK
            # In its own list a pair is met from both sides and counts from the smaller one.
            likely &= ~(here[start : start + 256, None] & (one[start : start + 256, None] >= two))
            a, b = np.nonzero(likely)
            for at in range(0, len(a), 65536):
                i, j = a[at : at + 65536], b[at : at + 65536]
                good = np.einsum("ij,ij->i", part[i], y[j]) >= cosine
                found_a.append(i[good] + start)
                found_b.append(j[good])
        a = np.concatenate(found_a) if found_a else np.empty(0, int)
        b = np.concatenate(found_b) if found_b else np.empty(0, int)
        # A class may stand on both sides of its own list; its rows are then added up below.
        nodes, at = np.unique(np.concatenate([one[a], two[b]]), return_inverse=True)
        counts = np.zeros(len(nodes), np.int64)
        np.add.at(counts, at[: len(a)], index["n"].to_numpy()[b])
        np.add.at(counts, at[len(a) :], queries["n"].to_numpy()[a])
        roots = _smallest_reachable(len(nodes), at[: len(a)], at[len(a) :], nodes)
        return pd.DataFrame({"cls": nodes, "links": counts, "root": roots})

    return links


def _linked_classes(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(cls, links, root) rows of the classes of one dimension."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    total = classes.count()
    share = min(1.0, SAMPLE / max(1, total))
    bound = min(int(-(1 << 63) + share * ((1 << 64) - 1)), (1 << 63) - 1)
    sample = unit(
        r[0] for r in classes.where(F.xxhash64("cls", F.lit("sample")) <= bound)
        .orderBy("cls").limit(2 * SAMPLE).select("embedding").collect()
    ) if total else np.empty((0, dim))
    if len(sample) == 0:
        sample = unit([classes.select("embedding").first()[0]])
    # Lists grow with the square root of the data, as far as the sample can place centroids.
    words = Quantizer(sample, int(min(LISTS, len(sample), max(1, np.sqrt(total) / 2))))

    def assign(batches):
        for rows in batches:
            if len(rows) == 0:
                continue
            x = unit(rows["embedding"])
            near, codes, error = words.encode(x)
            probed = words.probes(x, near, reach)
            probed &= np.arange(probed.shape[1])[None] >= near[:, None]
            yield rows.assign(
                list=near, codes=[c.tobytes() for c in codes], error=error,
                probes=[np.flatnonzero(p).astype(np.int32) for p in probed],
            )

    coded = checkpointed(classes.mapInPandas(
        assign,
        "cls bigint, label bigint, embedding array<float>, n bigint, list int, codes binary, "
        "error double, probes array<int>",
    ))
    asked = coded.select(
        "cls", "label", "embedding", "n", "list", F.explode("probes").alias("probe")
    )
    sizes = coded.groupBy("label", F.col("list").alias("probe")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    askers = coded.select("label", F.explode("probes").alias("probe")).groupBy(
        "label", "probe").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cells = checkpointed(sizes.join(askers, ["label", "probe"]))
    index = (
        coded.withColumnRenamed("list", "probe").join(cells, ["label", "probe"])
        .withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")))
        .withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1L)")))
        .select("label", "probe", "block", "chunk", "cls", "n", "embedding", "codes", "error")
    )
    queries = (
        asked.join(cells, ["label", "probe"])
        .withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit("chunk")), F.col("chunks")))
        .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)")))
        # Both sides come from one table; new names keep their columns apart.
        .select(*[F.col(c).alias(c) for c in
                  ("label", "probe", "block", "chunk", "cls", "n", "embedding", "list")])
    )
    keys = ["label", "probe", "block", "chunk"]
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        _group_links(words, cosine), "cls bigint, links bigint, root bigint"
    )


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = vectors.select(
        "vec_id", F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    usable = F.expr(
        "label is not null and embedding is not null and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= 3.4028234663852886E38D)"
        " and exists(embedding, x -> x <> 0)"
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = checkpointed(
        rows.where("usable").groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    linked = None
    for dim in dims:
        own = classes.where(F.size("embedding") == dim).select("cls", "label", "embedding", "n")
        part = _linked_classes(own, dim, cosine)
        linked = part if linked is None else linked.unionByName(part)
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if linked is None:
        return alone.withColumn("kept", F.lit(True))
    linked = checkpointed(linked)
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(linked.where("cls <> root"), "cls", "root")
    known = checkpointed(
        classes.join(counts, "cls", "left").join(
            joined.withColumnRenamed("node", "cls"), "cls", "left"
        ).select(
            "label", "embedding", "first", F.coalesce("component", "cls").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    told = known.join(least, "component").select("label", "embedding", "n_links", "component_id")
    found = rows.where("usable").join(told, ["label", "embedding"]).select(
        "vec_id", "n_links", "component_id"
    )
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
