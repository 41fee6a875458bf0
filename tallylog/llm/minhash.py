"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature. A document's set is its distinct word shingles. Two permutations of the 32-bit numbers
make all coordinates: the first places the shingles, the second, circularly shifted by k places,
gives coordinate k as its minimum over them. 128 coordinates are cut into 32 bands of 4; two
documents of similarity 0.8 miss each other in all bands with probability (1 - 0.8^4)^32 < 1e-7.

Candidates. Equal word sequences form one class and only its smallest id goes on, so copies never
meet as pairs. A bucket of at most ``SMALL`` classes gives all its pairs. A larger one pairs each
member with the bucket's hubs only, among them the member with the most company over all its buckets
(the common source of near copies). After these links are verified and joined, a larger bucket is

- done, if all its members are in one component;
- a crowd with stragglers, if one component holds at least half of it: each straggler is compared
  with that whole component and its other stragglers, exactly, in blocks of bounded size. The
  queries are the stragglers, and only links are put out;
- mixed otherwise, as with texts that only share a passage: finer buckets, of 8, 16, 32 and 64
  coordinates, join what they can; then the members are joined exactly on their rare shingles.

Rare shingles. Of two sets in one order of all shingles, the first shared one has at least the
overlap at or after it. So at a threshold t it lies among the first n - ceil(2 t n / (1 + t)) + 1 of
the smaller set and the first n - ceil(t n) + 1 of the larger one; only these meet. The order is by
the frequency in a sample of the members, so passages come last. It settles the cost alone: any
order finds every pair. A shingle of at most ``SMALL`` members gives its pairs of two components that
sizes and places allow. A more frequent one is treated as a bucket is: a crowd with stragglers, or
else a blocked exact search of the smaller sets (by their shorter part) against all its members. Only
that last case is quadratic in a group, in comparisons and not in rows.

So a bucket with a third of all rows costs rows in proportion to its members, and no member of any
bucket is left out.

Verification. Pairs whose signatures agree in under 60 % of the coordinates are left (0.8 alike
pairs do with probability under 1e-7); all others are confirmed on the full shingle sets of the
whole texts, hashed to 64 bits. Confirmed links are joined into components.

Nothing is collected: buckets are counted by grouped sums with map-side combining, and joins on hot
buckets can be split by adaptive execution.

Edge cases: null and empty texts and texts without words have an empty set and link with nothing.
A null id links with nothing, has a null component and is kept. Rows that repeat an id count as one
document and each get its component. Extra columns are not looked at. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallylog.llm.common import ascii_words, column_lists, jaccard, mixed64, shingle_set
from tallylog.llm.components import TASK_LINKS, components
from tallylog.session import checkpointed

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Classes of a bucket that are paired with each other; larger buckets take the ways above.
SMALL = 32
#: Hubs of a larger bucket.
HUBS = 2
#: Bands of the keys that the levels of finer buckets double.
DEPTHS = (1, 2, 4, 8)
#: Documents on either side of one task of the exact search for stragglers.
BLOCK = 512
#: Documents of a block of the cells in which pairs are confirmed.
CELL = 256
#: Bits of a filter for each wanted value, those for an id (whose rows are wide), and the most that a
#: filter has (64 MB).
FILTER_BITS, ID_BITS, MOST_BITS = 16, 64, 1 << 29
#: Tasks that the rows of one component are spread over.
SALTS = 64
#: Counters of the frequencies that order shingles, and the documents and tasks that they are counted
#: in. All settle the order, hence the cost, and not the result.
SLOT_BITS, ORDER_SAMPLE, ORDER_TASKS = 20, 20_000, 16
#: Coordinates that must agree before the full sets are compared.
AGREEING = int(0.6 * COORDINATES)

_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 128 circulant minima of a non-empty set of 64-bit hashes."""
    placed = _permuted((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(placed), 2048):  # the table of shifts stays in the cache
        table = placed[None, start : start + 2048] + _SHIFTS
        np.minimum(out, _permuted(table, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    four = minima.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed64(key * np.uint64(0x9E3779B97F4A7C15) + four[:, i])
    return key.view(np.int64)


_SIGNED = "id bigint, n_shingles bigint, digest binary, bands array<bigint>, low binary"


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, set size, digest of the word sequence, band keys and the low byte of each coordinate."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column_lists(batch, ["id", "text"])
            counts, digests, bands, lows = [], [], [], []
            for text in texts:
                words = ascii_words(text)
                shingles = shingle_set(words, size)
                counts.append(len(shingles))
                if len(shingles) == 0:
                    digests.append(None), bands.append(None), lows.append(None)
                    continue
                minima = signature(shingles)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bands.append(band_keys(minima))
                lows.append(minima.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    pa.array(lows, pa.binary()),
                ],
                ["id", "n_shingles", "digest", "bands", "low"],
            )

    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(sign, _SIGNED)


def _few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Narrow rows, checkpointed, in as few parts as hold ``TASK_LINKS`` each.

    What a later step leaves over is often little; one part then meets another without an exchange.
    Rows are counted unless ``most``, which they do not exceed by much, is known.
    """
    kept = checkpointed(rows)
    return kept.coalesce(_parts(kept.count() if most is None else most))


def _parts(rows: int) -> int:
    return max(1, -(-rows // TASK_LINKS))


def _likely_among(
    rows: DataFrame, column: str, wanted: DataFrame, bits_each: int = FILTER_BITS
) -> DataFrame:
    """The rows whose value is in ``wanted`` (a column of that name), and few others.

    A bitmap of bounded size is sent to the scan, so the other rows are left before anything moves.
    False positives cost rows only: an exact join must follow.
    """
    bits = min(MOST_BITS, max(1 << 15, bits_each * wanted.count()))

    def slot(values: DataFrame) -> DataFrame:
        return values.withColumn("_slot", F.pmod(F.xxhash64(column, F.lit("slot")), F.lit(bits)) + 1)

    parts = slot(wanted).groupBy(F.bitmap_bucket_number("_slot").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 + 1 as int), 1)), 16, 10) as int)"
    placed = slot(rows).withColumns(
        {"_part": F.bitmap_bucket_number("_slot"), "_at": F.bitmap_bit_position("_slot")})
    return (
        placed.join(F.broadcast(parts), "_part")
        .where(F.expr(f"shiftright({byte}, cast(_at % 8 as int)) % 2 = 1"))
        .select(*rows.columns)
    )


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given distinct ids, found before anything wide moves."""
    # An inner join, since a semi-join would be pushed below the filter.
    return _likely_among(rows, "id", ids, ID_BITS).join(ids, "id").select(*rows.columns)


def _bucketed(members: DataFrame) -> DataFrame:
    """Members of the buckets (key) that hold several, with their number n."""
    counts = checkpointed(
        members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return checkpointed(_likely_among(members, "key", counts.select("key")).join(counts, "key"))


def _small_pairs(held: DataFrame) -> DataFrame:
    """All pairs of the small buckets."""
    group = held.where(F.col("n") <= SMALL).groupBy("key").agg(
        F.array_sort(F.collect_set("id")).alias("ids"))
    return group.select("ids", F.posexplode("ids").alias("at", "a")).select(
        "a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))


def _star_pairs(large: DataFrame) -> DataFrame:
    """Each member of the large buckets with the hubs of its bucket."""
    # The sum of its bucket sizes tells how much company a member has.
    company = large.groupBy("id").agg(F.sum("n").alias("company"))
    rank = F.struct("company", F.xxhash64("id").alias("h"), "id")
    hubs = large.join(company, "id").groupBy("key").agg(
        F.max(rank).alias("hub"),
        F.max_by(F.col("id"), F.xxhash64("id", F.lit("second"))).alias("other"),
    )
    stars = large.select("key", "id").join(
        hubs.select("key", F.explode(F.array("hub.id", "other")).alias("hub")), "key"
    )
    return stars.where("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def _finer_pairs(classes: DataFrame, mixed: DataFrame, most: int) -> DataFrame:
    """Pairs of the finer buckets under the given large ones, of which there is one at least."""
    found, large = None, mixed
    for depth in DEPTHS:
        if large.isEmpty():
            break
        # The bands after those that a key has, read around, double it.
        more = F.expr(f"xxhash64(slice(concat(bands, bands), band + {depth + 1}, {depth}))")
        held = _bucketed(
            large.select("key", "id", "band").join(classes.select("id", "bands"), "id")
            .select("id", "band", F.xxhash64("key", more).alias("key"))
        ).coalesce(_parts(most))
        large = held.where(F.col("n") > SMALL)
        pairs = _small_pairs(held).unionByName(_star_pairs(large))
        found = pairs if found is None else found.unionByName(pairs)
    return found.coalesce(_parts(most))


def _agreeing():
    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = (
            np.frombuffer(b"".join(s), np.uint8).reshape(len(s), COORDINATES) for s in (a, b)
        )
        return pd.Series((one == two).sum(axis=1) >= AGREEING)

    return agree


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), all distinct, whose full shingle sets are alike enough.

    Pairs are dealt to cells so that a text moves once a cell and not once a pair. A pair goes to the
    group of the smallest document that its first end reaches in two steps, which most pairs of a
    cluster share; it settles the cost alone. Small groups share a cell; a large one is cut into
    blocks of ``CELL`` documents and has a cell for each two of its blocks.
    """
    # Not a union, which would part what lies in one place.
    most = 2 * pairs.count()
    pairs = pairs.coalesce(_parts(most))
    steps = pairs.select(F.expr("inline(array(struct(a as node, b as other), struct(b as node, a as other)))"))
    one = _few(
        steps.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low")), most)
    two = steps.join(one.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
        F.min("low").alias("lead"))
    placed = _few(two, most)
    sizes = placed.groupBy("lead").agg(F.count(F.lit(1)).alias("m"))
    cells = max(1, placed.count() // CELL)
    large = F.col("m") > CELL
    mixed = F.pmod(F.xxhash64("lead", F.lit("cell")), F.lit(cells))
    groups = sizes.select(
        "lead", large.alias("own"), F.when(large, F.col("lead")).otherwise(mixed).alias("cell"),
        F.when(large, F.ceil(F.col("m") / CELL)).otherwise(F.lit(1)).alias("blocks"))

    def block(end: str) -> Column:
        return F.pmod(F.xxhash64(end, F.lit("block")), F.col("blocks"))

    keys = ["own", "cell", "x", "y"]
    led = pairs.join(placed.withColumnRenamed("node", "a"), "a").withColumnRenamed("b", "id")
    dealt = _few(
        _spread_join(led, groups).withColumnRenamed("id", "b")
        .select("own", "cell", block("a").alias("x"), block("b").alias("y"), "a", "b"),
        most,
    )
    ends = dealt.select(*keys, F.explode(F.array("a", "b")).alias("id")).distinct()
    # Both sides come from one table; new names keep their columns apart.
    members = ends.join(texts, "id").select(*[F.col(c).alias(c) for c in (*keys, "id", "text")])

    def compare(key, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, list[np.ndarray]] = {}  # rows that repeat an id may differ
        for id_, text in zip(held["id"], held["text"]):
            sets.setdefault(id_, []).append(shingle_set(ascii_words(text), size))
        found = []
        for a, b in zip(rows["a"], rows["b"]):
            for one, two in product(sets.get(a, ()), sets.get(b, ())):
                both, either = jaccard(one, two)
                if 100 * both >= percent * either and either > 0:
                    found.append((a, b))
                    break
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(
        compare, "a bigint, b bigint")


def _spread_join(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """Join rows (id, lead) to one row per lead, when one lead may have most of the rows."""
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit("spread")), F.lit(SALTS)).cast("int"))
    return salted.join(leads.withColumn("_salt", F.explode(salts)), ["lead", "_salt"]).drop("_salt")


def _straggler_links(
    stragglers: DataFrame, crowd: DataFrame, texts: DataFrame, size: int, percent: int
) -> DataFrame:
    """Links (a, b) of the stragglers (id, lead) with the crowd (id, lead) of the same lead."""

    def compare(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(index) and len(queries):
            sets = [shingle_set(ascii_words(t), size) for t in index["text"]]
            ids, sizes = index["id"].to_numpy(), np.array([len(x) for x in sets])
            order = np.argsort(sizes, kind="stable")
            sets, ids, sizes = [sets[i] for i in order], ids[order], sizes[order]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            every, label = np.concatenate(sets), np.arange(len(sets))
            for one, text in zip(queries["id"], queries["text"]):
                own = shingle_set(ascii_words(text), size)
                # Only sets of a size near its own can be alike enough.
                low = np.searchsorted(100 * sizes, percent * len(own), "left")
                high = np.searchsorted(percent * sizes, 100 * len(own), "right")
                if low >= high:
                    continue
                part = every[ends[low] : ends[high]]
                at = np.searchsorted(own, part)
                at[at == len(own)] = 0
                hits = np.add.reduceat((own[at] == part).astype(np.int64), ends[low:high] - ends[low])
                either = len(own) + sizes[low:high] - hits
                hit = low + np.flatnonzero((100 * hits >= percent * either) & (ids[low:high] != one))
                # One link to each group of sets that earlier links of this cell join.
                groups, where = np.unique(label[hit], return_index=True)
                found += [(one, other) for other in ids[hit[where]]]
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def share(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))

    crowd = _few(crowd)
    texts = _likely_among(texts, "id", crowd.select("id").distinct(), ID_BITS)
    cells = share(crowd, "blocks").join(share(stragglers, "chunks"), "lead")
    index = (
        _spread_join(crowd, cells)
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")))
        .withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1L)")))
        .join(texts, "id").select("lead", "block", "chunk", "id", "text")
    )
    queries = (
        _spread_join(stragglers, cells)
        .withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")))
        .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)")))
        .join(texts, "id")
        .select(*[F.col(c).alias(c) for c in ("lead", "block", "chunk", "id", "text")])
    )
    keys = ["lead", "block", "chunk"]
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        compare, "a bigint, b bigint")


def _shingle_order(members: DataFrame, size: int) -> np.ndarray:
    """Frequency of each slot of shingles in a sample of the members (id, text).

    The sample is counted in few tasks, and a slot that a task sees once counts as not seen, so what
    the tasks put out is the frequent slots and not the shingles of the sample.
    """
    total = members.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in column_lists(batch, ["text"])[0]:
                slots = shingle_set(ascii_words(text), size) >> np.uint64(64 - SLOT_BITS)
                seen += np.bincount(slots.astype(np.int64), minlength=len(seen))
        at = np.flatnonzero(seen > 1)
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part])], ["slot", "n"])

    share = F.pmod(F.xxhash64("id", F.lit("order")), F.lit(total)) < ORDER_SAMPLE
    counts = (
        members.where(share).select("text").repartition(ORDER_TASKS)
        .mapInArrow(count, "slot bigint, n bigint")
        .groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    )
    order = np.zeros(1 << SLOT_BITS, np.uint32)
    order[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return order


_RARE = "token bigint, id bigint, component bigint, size int, at int, indexed boolean"


def _rare_shingles(members: DataFrame, size: int, percent: int) -> DataFrame:
    """The first shingles of each member (id, component, text), with their places in the order.

    ``indexed`` ones are those by which a set meets the sets that are at least as large.
    """
    order = _shingle_order(members, size)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, component, text in zip(*column_lists(batch, ["id", "component", "text"])):
                own = shingle_set(ascii_words(text), size)
                n = len(own)
                probed = n + percent * n // -100 + 1
                indexed = n + 2 * percent * n // -(100 + percent) + 1
                own = own[np.lexsort((own, order[own >> np.uint64(64 - SLOT_BITS)]))[:probed]]
                at = np.arange(probed, dtype=np.int32)
                out.append((own.view(np.int64), np.full(probed, id_), np.full(probed, component),
                            np.full(probed, n, np.int32), at, at < indexed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out)],
                ["token", "id", "component", "size", "at", "indexed"],
            )

    return members.select("id", "component", "text").mapInArrow(first, _RARE)


def _rare_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of two components that sizes and places of a shared shingle allow."""
    group = held.groupBy("token").agg(
        F.array_sort(F.collect_list(F.struct("size", "id", "at", "component", "indexed"))).alias("m"))
    allowed = f"""filter(slice(m, i + 2, size(m)), y -> x.component <> y.component
        and 100L * x.size >= {percent}L * y.size
        and {100 + percent}L * least(x.size - x.at, y.size - y.at) >= {percent}L * (x.size + y.size))"""
    return (
        group.select("m", F.posexplode("m").alias("i", "x")).where("x.indexed")
        .select(F.col("x.id").alias("one"), F.explode(F.expr(allowed)).alias("y"))
        .select(F.least("one", "y.id").alias("a"), F.greatest("one", "y.id").alias("b"))
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id and kept (id = component_id)."""
    signed = checkpointed(signatures(docs, size, id_col, text_col))
    known = signed.where("digest is not null and id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("first"))
    # The row of its class with the smallest id carries the bands; rows that repeat it add nothing.
    classes = checkpointed(
        known.join(first, "digest").where("id = first").select("id", "bands", "low")
    )

    def likely(pairs: DataFrame, owners: DataFrame) -> DataFrame:
        """The distinct pairs of rows of ``owners`` whose signatures agree enough."""
        lows = owners.groupBy("id").agg(F.min("low").alias("low"))
        return checkpointed(
            pairs.distinct()
            .join(lows.select(F.col("id").alias("a"), F.col("low").alias("low_a")), "a")
            .join(lows.select(F.col("id").alias("b"), F.col("low").alias("low_b")), "b")
            .where(_agreeing()("low_a", "low_b"))
            .select("a", "b")
        )

    held = _bucketed(classes.select("id", F.posexplode("bands").alias("band", "key")))
    large = checkpointed(held.where(F.col("n") > SMALL))
    most = large.count()
    large = large.coalesce(_parts(most))
    close = likely(_small_pairs(held).unionByName(_star_pairs(large)), classes)
    # Whole texts of all that may still be compared, moved once.
    needed = checkpointed(close.select(F.explode(F.array("a", "b")).alias("id")).unionByName(
        large.select("id")).distinct())
    every = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")
    ).where("text is not null")
    texts = checkpointed(_of_ids(every, needed))

    def joined_by_rare(
        mixed: DataFrame, own: DataFrame, own_texts: DataFrame, linked: DataFrame
    ) -> DataFrame:
        """The components with every link between members of the mixed buckets, whose signatures
        and texts are ``own`` and ``own_texts``."""
        placed = mixed.select("key", "id").join(linked.withColumnRenamed("node", "id"), "id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "id"))
        parted = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        members = _few(
            placed.join(parted, "key", "left_semi").select("id", "component").distinct(), most
        ).join(own_texts.dropDuplicates(["id"]), "id")
        rare = checkpointed(_rare_shingles(members, size, percent))
        shingles = rare.count()
        rare = rare.coalesce(_parts(shingles))
        shared = rare.groupBy("token").agg(
            F.count(F.lit(1)).alias("n"), F.max("indexed").alias("any"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).where("n > 1 and any and low < high")
        held = _few(rare.join(shared.select("token", "n"), "token"), shingles)
        links = linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(
            _confirmed(
                likely(_rare_pairs(held.where(F.col("n") <= SMALL), percent), own),
                own_texts, size, percent))
        hot = held.where(F.col("n") > SMALL)
        if hot.isEmpty():
            return components(links, "a", "b")
        lead = _few(
            hot.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
            .groupBy("token").agg(
                F.max_by("component", "m").alias("lead"), F.max("m").alias("most"),
                F.sum("m").alias("n")),
            shingles,
        )
        stragglers = _few(
            hot.join(lead.where("2 * most >= n"), "token").where("component <> lead")
            .select("id", "lead").distinct(),
            shingles,
        )
        # Shingles with the same members, as those of one passage have, are looked at once.
        groups = (
            hot.join(lead.where("2 * most < n").select("token"), "token", "left_semi")
            .groupBy("token").agg(
                F.count(F.lit(1)).alias("n"),
                F.bit_xor(F.xxhash64("id", "indexed")).alias("x"),
                F.sum(F.xxhash64("indexed", "id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
            .groupBy("n", "x", "s").agg(F.min("token").alias("token")).select("token")
        )
        several = _few(hot.join(groups, "token", "left_semi").select(
            "id", F.col("token").alias("lead"), "indexed"), shingles)
        if not stragglers.isEmpty():
            crowd = _spread_join(
                linked.select(F.col("node").alias("id"), F.col("component").alias("lead")),
                stragglers.select("lead").distinct(),
            ).select("id", "lead").unionByName(stragglers)
            links = links.unionByName(_straggler_links(stragglers, crowd, texts, size, percent))
        if not several.isEmpty():
            links = links.unionByName(_straggler_links(
                several.where("indexed").select("id", "lead"), several.select("id", "lead"),
                texts, size, percent))
        return components(links, "a", "b")

    linked = _few(components(_confirmed(close, texts, size, percent), "a", "b"))
    if not large.isEmpty():
        links = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
        joined = _few(
            large.join(linked.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")),
            most,
        )
        parts = joined.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        lead = _few(parts.groupBy("key").agg(
            F.max_by("component", "m").alias("lead"), F.max("m").alias("most"),
            F.sum("m").alias("n"),
        ), most)
        stragglers = _few(
            joined.join(lead.where("2 * most >= n and most < n").select("key", "lead"), "key")
            .where("component <> lead").select("id", "lead").distinct(),
            most,
        )
        if not stragglers.isEmpty():
            members = linked.select(F.col("node").alias("id"), F.col("component").alias("lead"))
            leads = stragglers.select("lead").distinct()
            crowd = _spread_join(members, leads).select("id", "lead").unionByName(stragglers)
            links = links.unionByName(_straggler_links(stragglers, crowd, texts, size, percent))
        mixed = _few(joined.join(lead.where("2 * most < n").select("key"), "key", "left_semi"), most)
        some = not mixed.isEmpty()
        if some:
            # Signatures and texts of these members alone, moved once for all that follows.
            ids = _few(mixed.select("id").distinct(), most)
            own, own_texts = _few(_of_ids(classes, ids), most), checkpointed(_of_ids(texts, ids))
            links = links.unionByName(
                _confirmed(
                    likely(_finer_pairs(own, mixed, most), own), own_texts, size, percent))
        linked = _few(components(links, "a", "b"))
        if some:
            linked = joined_by_rare(mixed, own, own_texts, linked)
    found = first.join(linked, F.col("first") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "first").alias("component")
    )
    # The smallest id of a component is the smallest first id of its classes.
    return (
        signed.join(found, "digest", "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each component, columns as they are.

    Of rows that repeat an id one stays. Rows with a null id all stay.
    """
    found = checkpointed(near_duplicates(docs.select("doc_id", "text"), size, percent))
    gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    # Ids are unique as a rule; only those that are not need their rows brought together.
    repeated = checkpointed(
        found.where("kept and id is not null")
        .groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("doc_id")
    )
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = docs.join(gone.unionByName(repeated), "doc_id", "left_anti")
    return rest.select(*docs.columns).unionByName(once.select(*docs.columns))
