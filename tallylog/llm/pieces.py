"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all normal pieces. It reads a text once; at each position its output links give
every piece that ends there, and each of them relaxes the best score of the prefix it completes. The
back pointers then give the segmentation with the largest sum of scores. A character that no piece
covers is an unknown of the lowest score less 10 and is spelled with byte pieces.

Spaces become U+2581 and one is put in front, as the model's settings say. When no piece goes on
from another character into U+2581 (tested on the vocabulary), the best segmentation of a text is
that of its parts, each beginning with its spaces; parts repeat, so they are looked up in a bounded
cache. Ties go to the segmentation with the longer last piece.

Edge cases: null and empty texts have no id and decode to the empty text. A space at the start is
kept (it follows the one in front). U+2581 in a text cannot be told from a space and decodes as one. Very long texts take memory in proportion to the longest part.
Repeated rows are encoded each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallylog.llm.common import BoundedCache, column_lists

SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class PieceModel:
    """The pieces of a model file, its automaton, and encoding and decoding with them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
            for i in range(n)
        ]
        scores = [model.get_score(i) for i in range(n)]
        self.bytes = {int(m[1], 16): i for i in range(n)
                      if model.is_byte(i) and (m := _BYTE.fullmatch(self.pieces[i]))}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.raw = [
            bytes([self.byte_of[i]]) if i in self.byte_of
            else b"" if i in self.control else self.pieces[i].encode()
            for i in range(n)
        ]
        self.unknown = model.unk_id()
        self.unknown_score = min((s for s, x in zip(scores, special) if not x), default=0.0) - 10
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if not special[i] and piece:
                self.automaton.add_word(piece, (len(piece), i, scores[i]))
        self.automaton.make_automaton()
        self.splits = not any(
            re.search(f"[^{SPACE}]{SPACE}", p) for p, x in zip(self.pieces, special) if not x
        )
        self.known = BoundedCache(self._viterbi, 200_000)

    def _viterbi(self, text: str) -> tuple[bytes, float]:
        """Ids (as bytes) and score of the best segmentation of a text without further splits."""
        n = len(text)
        best, step = [0.0] + [None] * n, [None] * (n + 1)
        done = 0  # positions up to here are final

        def close(end: int) -> None:
            # A position no piece reached is reached by an unknown character.
            nonlocal done
            while done < end:
                done += 1
                if best[done] is None:
                    best[done] = best[done - 1] + self.unknown_score
                    step[done] = (1, self.unknown)

        if len(self.automaton):
            for last, (length, piece, score) in self.automaton.iter(text):
                end = last + 1
                close(last)
                start = best[end - length]
                total = start + score
                # Output links go from the longest piece to shorter ones; ties keep the longest.
                if best[end] is None or total > best[end]:
                    best[end], step[end] = total, (length, piece)
        close(n)
        ids, at = [], n
        while at > 0:
            length, piece = step[at]
            at -= length
            if piece == self.unknown and self.bytes:
                raw = text[at : at + length].encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in reversed(raw)]
            else:
                ids.append(piece)
        return np.array(ids[::-1], "<u4").tobytes(), best[n]

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        """Ids and total score of a text."""
        if not text:
            return np.empty(0, np.uint32), 0.0
        marked = SPACE + text.replace(" ", SPACE)
        parts = _PARTS.findall(marked) if self.splits else [marked]
        found = [self.known[part] for part in parts]
        ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
        return ids, float(sum(f[1] for f in found))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces are joined, control pieces left out."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per Python worker and file."""
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, score) of every row: its ids and the sum of their scores."""
    path = path or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_in, texts = column_lists(batch, ["doc_id", "text"])
            found = [piece_model(path).encode(text) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids_in, pa.int64()),
                    pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "ids", "score"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        encode, "doc_id bigint, ids array<int>, score double"
    )


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""
    path = path or default_model()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, ids = column_lists(batch, ["doc_id", "ids"])
            texts = [piece_model(path).decode(np.array(i or [], np.int64)) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of encoding and decoding every row: counts, check sum, score and equality.

    Ids are decoded in the task that encoded them, so they are not moved.
    """
    path = path or default_model()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, rows = piece_model(path), []
            byte_ids = np.fromiter(model.byte_of, np.int64, len(model.byte_of))
            for doc, text in zip(*column_lists(batch, ["doc_id", "text"])):
                ids, score = model.encode(text)
                rows.append((
                    doc, len(ids), int(np.isin(ids, byte_ids).sum()),
                    zlib.crc32(ids.astype("<u4").tobytes()), score,
                    model.decode(ids) == (text or ""),
                ))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                ["doc_id", "n_ids", "n_bytes", "ids_crc32", "score", "decoded_equal"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        turn, "doc_id bigint, n_ids bigint, n_bytes bigint, ids_crc32 bigint, score double, "
        "decoded_equal boolean",
    )
