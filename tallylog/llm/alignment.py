"""Alignment of two tokenizers' tokens by the byte offsets where both end a token.

A text is encoded twice: a space and the text by a byte-level BPE (A), the text by a SentencePiece
model (B), which adds that space itself. Each tokenizer gives an ascending list of byte offsets at
which its tokens end. The shorter list drives a galloping search in the longer one: steps double
until the value is passed, then a binary search closes in. The common offsets cut both token lists
into groups; differences of their ranks are the groups' token ranges. All A-B pairs within a group
are linked.

An id pair's count is the number of documents that hold it linked. One pass encodes and aligns and
writes, for a bounded batch of documents, the batch's distinct pairs with their document counts and
each document's pairs as places in that list. Pairs are summed over batches and compared with the
best count of their A id; the facts go back to the batches that hold the pair, so rows move once a
batch and pair, not once a link.

Parts. Neither tokenizer joins characters across a single space or a line feed of a text of ASCII
and plain Latin letters, so both end a token there: such a text is aligned part by part, and prose
repeats its parts. The new parts of a batch are encoded and aligned as one long text and then held
in a bounded cache. The tokenizers' own files are tested for this; all other texts are encoded and
aligned whole.

Edge cases: texts that are null or empty, or whose joined token bytes differ from the space and the
text, have no tokens: zeros and an empty groups_sha256. Rows that repeat an id are documents of
their own. Equal counts are all best. A group of very many tokens is linked by its distinct ids and
their numbers, so its pairs are never listed link by link. Extra columns are not read. An empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallylog.llm.common import column_lists
from tallylog.llm.tokens import CACHED, Generations
from tallylog.session import checkpointed

#: Links of one group that are listed; larger groups are counted by distinct ids.
LISTED = 1 << 14

#: How the byte-level splitter cuts words; a fixed value.
BYTE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Texts that may be cut: ASCII and Latin letters that no normalisation changes, and white space only
# as single spaces or line feeds between other characters.
_PLAIN = re.compile(r"(?![ \n])(?!.*[ \n](?:[ \n]|\Z))[\n -~À-ÖØ-öø-ÿ]*", re.S)
# Parts of a space and such a text that both tokenizers encode alone.
_PARTS = re.compile(r"[ \n][^ \n]*")


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """Ranks in both ascending lists of the values they share; ``short`` drives."""
    at_short, at_long, place, n = [], [], 0, len(long)
    long = [*long, float("inf")]  # so that a place always has a value
    for rank, value in enumerate(short):
        found = long[place]
        if found < value:
            step = 1
            while place + step < n and long[place + step] < value:
                step += step
            place = bisect_left(long, value, place + (step >> 1) + 1, min(place + step, n))
            found = long[place]
        if found == value:
            at_short.append(rank)
            at_long.append(place)
            place += 1
    return at_short, at_long


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in two ascending arrays of their common values; the shorter one drives."""
    if len(a) <= len(b):
        one, two = gallop(a.tolist(), b.tolist())
    else:
        two, one = gallop(b.tolist(), a.tolist())
    return np.array(one, np.int64), np.array(two, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes for the characters from
    U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: the bytes of each id, their lengths and how ids are written."""

    #: Whether parts of plain texts are known to be encoded alone.
    split: bool

    def __init__(self, tokens: list[bytes], ends: tuple[str, str]):
        self.bytes = np.array(tokens, object)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        #: Written ids, followed by a comma or by the mark that ends a group's side.
        self.written = np.array([f"{i}{mark}" for mark in ends for i in range(len(tokens))], object)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())


class ByteSide(Side):
    """A byte-level BPE of a tokenizer file, over a space and the text.

    A file whose merges make the ids in their order is run by tiktoken, which merges by rank, so its
    ids are the same; any other file is run by the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        splitter = settings.get("pre_tokenizer") or {}
        # The byte-level splitter begins a new word at each single space and line feed.
        self.split = (
            settings.get("normalizer") is None and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
            and all(t["special"] for t in settings.get("added_tokens", []))
        )
        alphabet = byte_alphabet()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        tokens = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
                  for t in names]
        super().__init__(tokens, (",", "|"))
        self.ranked = None
        vocabulary, merges = settings["model"]["vocab"], settings["model"]["merges"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        if self.split and all(vocabulary.get("".join(m)) == 256 + i for i, m in enumerate(pairs)):
            import tiktoken

            self.ranked = tiktoken.Encoding(
                "ranked", pat_str=BYTE_PATTERN, special_tokens={},
                mergeable_ranks={tokens[i]: i for i in range(256 + len(merges))})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked:
            return np.array(self.ranked.encode_ordinary(" " + text), np.int64)
        return np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64)


class PieceSide(Side):
    """A SentencePiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        tokens = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)
                  else p.replace("\u2581", " ").encode() for p in pieces]
        super().__init__(tokens, (",", ";"))
        # No piece may reach over a space or line feed, a first space must be an id of its own
        # before a line feed, and nothing else of a plain text may change.
        sample = "a b\nc é"
        self.split = (
            not any(re.search("[^\u2581]\u2581", p) or ("\n" in p and p != "\n") for p in pieces)
            and self.joined(np.array(self.model.encode(sample), np.uint32)) == f" {sample}".encode()
            and self.joined(np.array(self.model.encode("\n")[:1], np.uint32)) == b" "
        )

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Aligned(NamedTuple):
    """One text or part of a text with both its token lists."""

    n_a: int
    n_b: int
    n_groups: int
    #: Linked pairs, one for each link: the A id in the upper half of 64 bits, the B id in the lower.
    links: bytes
    #: Its groups as written, each with a semicolon after it.
    groups: str
    #: Distinct pairs of the large groups, and how often each is linked.
    large: tuple[np.ndarray, np.ndarray] | None = None


NOTHING = Aligned(0, 0, 0, b"", "")


def _large_pairs(a, b, in_a, in_b) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs linked in the given groups' tokens, and how often."""
    keys, times = [], []
    ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
    for n, m, end_a, end_b in zip(in_a, in_b, ends_a, ends_b):
        ua, ca = np.unique(a[end_a - n : end_a], return_counts=True)
        ub, cb = np.unique(b[end_b - m : end_b], return_counts=True)
        keys.append(((ua << 32)[:, None] | ub).ravel())
        times.append((ca[:, None] * cb).ravel())
    return np.concatenate(keys), np.concatenate(times)


class Aligner:
    """Aligns texts with both tokenizers, each repeated part once."""

    def __init__(self, first: Side, second: Side):
        self.first, self.second = first, second
        self.split = first.split and second.split
        self.known = Generations(CACHED // 2)

    def _cut(self, text: str, ends: np.ndarray) -> list[Aligned]:
        """The parts of ``text`` that end at the given byte offsets of its space and itself."""
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.first.encode(text), self.second.encode(text)
        if self.first.joined(a) != raw or self.second.joined(b) != raw:
            return [NOTHING] * len(ends)
        ends_a, ends_b = np.cumsum(self.first.lengths[a]), np.cumsum(self.second.lengths[b])
        at_a, at_b = common_ends(ends_a, ends_b)
        in_a, in_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        # Tokens in the order of the written groups: a group's A tokens, then its B tokens.
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        written = np.empty(len(a) + len(b), object)
        before, after = np.repeat(at_b + 1 - in_b, in_a), np.repeat(at_a + 1, in_b)
        written[np.arange(len(a)) + before] = self.first.written[a + last_a * len(self.first.lengths)]
        written[np.arange(len(b)) + after] = self.second.written[b + last_b * len(self.second.lengths)]
        # Each A token is linked with all B tokens of its group, from the group's first on.
        large = in_a * in_b > LISTED
        each = np.repeat(np.where(large, 0, in_b), in_a)
        until = np.cumsum(each)
        place = np.arange(until[-1]) + np.repeat(before - (until - each), each)
        links = (np.repeat(a, each) << 32) | b[place]
        groups = np.searchsorted(ends_a[at_a], ends) + 1
        tokens_a, tokens_b = at_a[groups - 1] + 1, at_b[groups - 1] + 1
        written, links = written.tolist(), links.tobytes()
        out, g0, a0, b0, l0 = [], 0, 0, 0, 0
        for g, n, m, l in zip(groups.tolist(), tokens_a.tolist(), tokens_b.tolist(),
                              until[tokens_a - 1].tolist()):
            out.append(Aligned(
                n - a0, m - b0, g - g0, links[8 * l0 : 8 * l],
                "".join(written[a0 + b0 : n + m])))
            g0, a0, b0, l0 = g, n, m, l
        if large.any():
            # Only a text that is not cut can have a large group worth the name; a part keeps its own.
            owner = np.searchsorted(groups, np.flatnonzero(large), "right")
            for unit in np.unique(owner):
                mine = np.flatnonzero(large)[owner == unit]
                take_a = np.concatenate([a[at_a[g] + 1 - in_a[g] : at_a[g] + 1] for g in mine])
                take_b = np.concatenate([b[at_b[g] + 1 - in_b[g] : at_b[g] + 1] for g in mine])
                pairs = _large_pairs(take_a, take_b, in_a[mine], in_b[mine])
                out[unit] = out[unit]._replace(large=pairs)
        return out

    def _learn(self, parts: set[str]) -> None:
        if len(self.known.new) <= self.known.limit:
            parts = parts.difference(self.known.new)
        missing = self.known.missing(parts)
        if missing:
            ends = np.cumsum([len(p.encode()) for p in missing])
            # A first part that begins with a line feed needs the space that both tokenizers add.
            missing_text = "".join(missing)
            if missing_text[0] == " ":
                found = self._cut(missing_text[1:], ends)
            else:
                found = self._cut("a" + missing_text, np.concatenate([[2], ends + 2]))[1:]
            self.known.new.update(zip(missing, found))

    def align(self, texts: list[str | None]) -> Iterator[tuple[Aligned, np.ndarray, np.ndarray]]:
        """Each text aligned, its distinct linked pairs in order and how often each is linked."""
        cut = [_PARTS.findall(" " + t) if t and self.split and _PLAIN.fullmatch(t) else None
               for t in texts]
        self._learn(set().union(*filter(None, cut)))
        find = self.known.new.__getitem__
        for text, parts in zip(texts, cut):
            if parts:
                n_a, n_b, n_groups, links, groups, large = zip(*map(find, parts))
                found = Aligned(sum(n_a), sum(n_b), sum(n_groups), b"".join(links), "".join(groups))
                many = [x for x in large if x is not None] if any(large) else []
            elif text:
                raw = (" " + text).encode("utf-8", "surrogatepass")
                found = self._cut(text, np.array([len(raw)]))[0]
                many = [found.large] if found.large else []
            else:
                found, many = NOTHING, []
            yield found, *_distinct(np.frombuffer(found.links, np.int64), many)


def _distinct(links: np.ndarray, large: list) -> tuple[np.ndarray, np.ndarray]:
    links = np.sort(links)
    at = np.flatnonzero(np.diff(links, prepend=-1))
    pairs, times = links[at], np.diff(np.append(at, len(links)))
    if not large:
        return pairs, times
    pairs = np.concatenate([pairs, *[p for p, _ in large]])
    times = np.concatenate([times, *[t for _, t in large]])
    pairs, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, times)
    return pairs, total


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """Both tokenizers, once per Python worker."""
    return Aligner(ByteSide(byte_path), PieceSide(piece_path))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_DOC = pa.struct([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()),
])
_DOC_SQL = (
    "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
)
_BATCH = pa.schema([
    ("batch", pa.int64()), ("docs", pa.list_(_DOC)), ("links", pa.binary()),
    ("pairs", pa.binary()), ("held", pa.binary()),
])
_BATCH_SQL = f"batch bigint, docs array<{_DOC_SQL}>, links binary, pairs binary, held binary"
_RESULT_SQL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string"
)


def _aligned_batches(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row a batch: its documents, distinct pairs, their document counts, and each document's
    pairs (numbers of pairs, then places, then times linked)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_parts = aligner(*paths)
        number = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches, number):
            ids, texts = column_lists(batch, ["doc_id", "text"])
            rows, pairs, times = [], [], []
            for start in range(0, len(ids), 64):  # few texts' links at once
                part = slice(start, start + 64)
                for doc, (found, pair, time) in zip(ids[part], known_parts.align(texts[part])):
                    digest = found.groups and hashlib.sha256(found.groups[:-1].encode()).hexdigest()
                    rows.append((doc, found.n_a, found.n_b, found.n_groups, int(time.sum()), digest))
                    pairs.append(pair), times.append(time)
            known, at, held = np.unique(
                np.concatenate(pairs), return_inverse=True, return_counts=True)
            links = b"".join([
                np.array([len(p) for p in pairs], "<i4").tobytes(),
                at.astype("<i4").tobytes(), np.concatenate(times).astype("<i8").tobytes(),
            ])
            docs_col = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r))
                        for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([docs_col], pa.list_(_DOC)),
                pa.array([zstandard.compress(links, 1)], pa.binary()),
                pa.array([known.astype("<i8").tobytes()], pa.binary()),
                pa.array([held.astype("<i4").tobytes()], pa.binary()),
            ], schema=_BATCH)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, _BATCH_SQL)


def _batch_pairs(aligned: DataFrame) -> DataFrame:
    """(batch, at, pair, held): the pairs of each batch in their order."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, held in zip(*column_lists(batch, ["batch", "pairs", "held"])):
                pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i4")
                for start in range(0, len(pairs), 1 << 17):
                    part = slice(start, min(start + (1 << 17), len(pairs)))
                    at = np.arange(part.start, part.stop, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), number)), pa.array(at), pa.array(pairs[part]),
                         pa.array(held[part])], ["batch", "at", "pair", "held"])

    return aligned.select("batch", "pairs", "held").mapInArrow(
        spread, "batch bigint, at int, pair bigint, held int")


def _counted(key: tuple, facts: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """The documents of one batch with the counts of their links."""
    order = np.argsort(facts["at"].to_numpy())
    total = facts["total"].to_numpy(np.int64)[order]
    best = facts["best"].to_numpy(bool)[order]
    frames = []
    for docs, links in zip(batch["docs"], batch["links"]):
        out = pd.DataFrame(list(docs))
        raw = zstandard.decompress(links)
        sizes = np.frombuffer(raw, "<i4", len(out))
        n = int(sizes.sum())
        at = np.frombuffer(raw, "<i4", n, 4 * len(out))
        times = np.frombuffer(raw, "<i8", n, 4 * (len(out) + n))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for name, value in (("n_best", times * best[at]), ("count_sum", times * total[at])):
            sums = np.concatenate([[0], np.cumsum(value)])
            out[name] = sums[ends[1:]] - sums[ends[:-1]]
        out["doc_id"] = out["doc_id"].astype("Int64")
        frames.append(out)
    return pd.concat(frames)


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: token, group and link numbers, and the counts of its links.

    ``paths`` are the files of the byte-level BPE and the SentencePiece model.
    """
    aligned = checkpointed(_aligned_batches(docs, paths or default_tokenizers()))
    pairs = _batch_pairs(aligned)
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("total"))
    counts = checkpointed(counts.withColumn("a", F.shiftright("pair", 32)))
    top = counts.groupBy("a").agg(F.max("total").alias("top"))
    facts = counts.join(top, "a").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    # A pair is in a batch once, so no pair has more rows than there are batches.
    known = pairs.select("batch", "at", "pair").join(facts, "pair").select("batch", "at", "total", "best")
    return known.groupBy("batch").cogroup(
        aligned.select("batch", "docs", "links").groupBy("batch")).applyInPandas(_counted, _RESULT_SQL)


def linked_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, documents): every linked id pair with the number of documents that hold it."""
    pairs = _batch_pairs(checkpointed(_aligned_batches(docs, paths or default_tokenizers())))
    return pairs.groupBy("pair").agg(F.sum("held").alias("documents")).select(
        F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"),
        "documents")
