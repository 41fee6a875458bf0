"""Token ids of whole texts with the tokenizers library, encoding each repeated chunk once.

The tokenizer in use drops white space and never joins characters across it, and a space or a line
feed takes part in no normalisation. A text's ids are therefore the ids of its chunks between
spaces and line feeds, one after another. ``safe_to_split`` tests the tokenizer's own settings for
this; with any other tokenizer whole texts are encoded. A text of plain letters is cut further, into
runs of letters and digits and runs of punctuation. Prose repeats its words, so these parts are
looked up in a bounded cache and the library encodes only those that are new.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Entries of one generation of the cache; changes speed only.
CACHED = 300_000

#: The one split pattern for which chunks, and in them letter and punctuation runs, are known to be
#: encoded alone. Fixed value: it must equal the tokenizer file's.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_CHUNK = re.compile(r"[^ \n]+")
# ASCII without the apostrophe, and Latin letters that normalisation leaves alone.
_PLAIN = re.compile(r"[ \n!-&(-~À-ÖØ-öø-įı-ňŊ-ž]*")
# Runs of letters and digits, and runs of punctuation, of a plain text.
_RUNS = re.compile(r"[^ \n!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+")


def safe_to_split(settings: dict) -> bool:
    """Whether the tokenizer drops white space and splits as ``SPLIT_PATTERN`` says."""
    normalizers = (settings.get("normalizer") or {}).get("normalizers", [])
    kinds = [n["type"] for n in normalizers]
    splitters = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = splitters[0] if splitters else {}
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and normalizers[1]["pattern"] == {"Regex": r"\s+"}
        and normalizers[1]["content"] == " "
        and split.get("type") == "Split"
        and split.get("pattern") == {"Regex": SPLIT_PATTERN}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in splitters[1:])
        and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])
                    for t in settings.get("added_tokens", []))
    )


class Generations:
    """A bounded look-up in two generations: a hit in the old one moves to the new one, and a full
    new one becomes the old. Frequent keys stay; a dropped one is computed again.
    """

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not known; the others are in the new generation afterwards."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        unknown = []
        for key in keys:
            if key not in self.new:
                value = self.old.get(key)
                if value is None:
                    unknown.append(key)
                else:
                    self.new[key] = value
        return unknown


class Encoder:
    """Encodes texts to arrays of unsigned 32-bit ids."""

    def __init__(self, path: str):
        # Spark runs one worker a core; the library's own threads would only get in the way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.split = safe_to_split(settings)
        added = [re.escape(t["content"]) for t in settings.get("added_tokens", [])]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.known = Generations(CACHED)

    def _whole(self, texts: list[str]) -> list[bytes]:
        every = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in every]

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens, in one call; it tells which text a token is from."""
        if not texts:
            return []
        found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = 4 * np.searchsorted(np.array(found.word_ids), np.arange(len(texts) + 1))
        ends = ends.tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, parts: set[str]) -> None:
        """Encode the parts that are new; those with an added token as texts of their own."""
        missing = self.known.missing(parts)
        added = [p for p in missing if self.added.search(p)]
        if added:
            self.known.new.update(zip(added, self._whole(added)))
            missing = list(set(missing).difference(added))
        self.known.new.update(zip(missing, self._library(missing)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        if not self.split:
            return [np.frombuffer(b, "<u4") for b in self._whole([t or "" for t in texts])]
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif _PLAIN.fullmatch(text) and not self.added.search(text):
                cut.append(_RUNS.findall(text.lower()))
            else:
                cut.append(_CHUNK.findall(text))
        self._learn({part for parts in cut for part in parts})
        find = self.known.new.__getitem__
        return [np.frombuffer(b"".join(map(find, parts)), "<u4") for parts in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
