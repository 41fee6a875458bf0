"""Personal identifiers: seeds by fixed shapes, more of them by bootstrapped contexts.

Seeds. E-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers are
found by their shapes in every whole text.

Slots. Every other number, and every address-like run, is a slot too: a candidate of a kind if its
looser shape allows one (an e-mail address with "(at)" or without a dotted domain, an IPv6 address, 13
to 19 digits, 7 to 12 digits), and a counter-example otherwise. A slot's lexical patterns are its two
words on the left, and one word on each side.

Graph. Patterns and instances (kind and normal value) are linked where a pattern surrounds the
instance; copies of a passage add nothing, since links are distinct. Seeds score 1, counter-examples
0. Each round Spark scores all patterns from their instances and all candidates from their patterns:

- a pattern's confidence for a kind is the summed score of its instances of that kind over the
  number of all its instances and one more; it counts with at least ``SUPPORT`` seeds of the kind
  and a confidence of at least ``CONFIDENT``;
- a candidate's score is 1 less the product of (1 - confidence) over its patterns of its kind, and it
  is an identifier from ``CONFIDENT`` on. A candidate with the value of a seed scores 1.

Rounds end when the accepted candidates stay the same, after ``ROUNDS`` at the latest. All
occurrences of an accepted candidate become spans. Hot patterns and values are summed in tasks first
and joined with salts; no group is gathered but the spans of one document.

Edge cases: null and empty texts have no spans and the digest of ''. Rows that repeat an id are
documents of their own. Slots without words around them have no pattern and stay out. Extra columns
are not read. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallylog.llm.common import column_lists
from tallylog.session import checkpointed

#: Kinds of identifiers, in the order in which spans are written.
KINDS = ("email", "ip", "card", "phone")
#: Kind of the slots that no looser shape allows.
OTHER = -1
#: Distinct seeds that a pattern needs, the least confidence of patterns and candidates, and rounds.
SUPPORT, CONFIDENT, ROUNDS = 3, 0.75, 5
#: Tasks over which the links of one pattern or value are spread in joins.
SALTS = 16
#: Characters on each side of a slot in which its words are looked for.
AROUND = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_MARK = re.compile(r" ?[(\[{](?:at|AT|At)[)\]}] ?|@")
_HOST = re.compile(
    r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[{](?:dot|DOT|Dot)[)\]}] ?)[A-Za-z0-9-]+)*")
_DOT = re.compile(r" ?[(\[{](?:dot|DOT|Dot)[)\]}] ?")
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_NUMBER = re.compile(r"[0-9](?:[ ().\-/]{0,2}[0-9])*")
_WORDS = re.compile(r"[^\W\d_]+|[:=#]")
_HAS_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def _local_start(text: str, end: int, low: int) -> int:
    """Where the run of local-part characters before ``end`` begins, not before ``low``."""
    while end > low and text[end - 1] in _LOCAL:
        end -= 1
    return end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 if value > 4 else 2 * value
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Identifiers of fixed shape, by kind and start; matches of one kind do not overlap."""
    found, low = [], 0
    if "@" in text:
        for domain in _DOMAIN.finditer(text):
            start = _local_start(text, domain.start(), low)
            if start < domain.start():
                low = domain.end()
                found.append(Span(0, start, low))
    if not _HAS_DIGIT.search(text):
        return found
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
               for part in match.group().split(".")):
            found.append(Span(1, *match.span()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(2, *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match.group())) <= 15:
                found.append(Span(3, *match.span()))
    return found


def normal_value(kind: int, text: str) -> str:
    """Spellings of one identifier have one value; very long values are shortened by their digest."""
    if kind in (2, 3):
        value = _digits(text)
    elif kind == 0:
        value = _DOT.sub(".", _MARK.sub("@", text)).lower()
    else:
        value = text.lower()
    return value if len(value) <= 64 else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


class Taken:
    """Stretches of a text that spans cover, to tell overlaps."""

    def __init__(self, spans: list[Span]):
        self.parts: list[list[int]] = []
        for start, end in sorted((s.start, s.end) for s in spans):
            if self.parts and start <= self.parts[-1][1]:
                self.parts[-1][1] = max(end, self.parts[-1][1])
            else:
                self.parts.append([start, end])
        self.at = 0

    def overlaps(self, start: int, end: int) -> bool:
        """Whether a span covers part of it; asked in ascending order of ``start``."""
        while self.at < len(self.parts) and self.parts[self.at][1] <= start:
            self.at += 1
        return self.at < len(self.parts) and self.parts[self.at][0] < end


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates and counter-examples outside of the base spans."""
    found, taken, low = [], Taken(base), 0
    for mark in _MARK.finditer(text):
        host = _HOST.match(text, mark.end())
        start = _local_start(text, mark.start(), low)
        if host and start < mark.start() and not taken.overlaps(start, host.end()):
            low = host.end()
            found.append(Span(0, start, low))
    taken = Taken(base)
    for match in _COLONS.finditer(text) if text.count(":") > 1 else ():
        if not taken.overlaps(*match.span()):
            try:
                ipaddress.IPv6Address(match.group())
            except ValueError:
                continue
            if _HAS_DIGIT.search(match.group()):
                found.append(Span(1, *match.span()))
    taken = Taken([*base, *found])
    for match in _NUMBER.finditer(text):
        start, end = match.span()
        if taken.overlaps(start, end):
            continue
        n = len(_digits(match.group()))
        joined = (start and (text[start - 1].isalpha() or text[start - 1] == "_")) or (
            end < len(text) and (text[end].isalpha() or text[end] == "_"))
        kind = OTHER if joined else 2 if 13 <= n <= 19 else 3 if 7 <= n <= 12 else OTHER
        found.append(Span(kind, start, end))
    return found


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a slot: two words before it; one before and one after it."""
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - AROUND) : start])[-2:]]
    after = _WORDS.search(text[end : end + AROUND])
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after.group().lower()}")
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


_SLOT = pa.struct([
    ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
    ("seed", pa.bool_()), ("patterns", pa.list_(pa.string())),
])
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("base_sha256", pa.string()),
    ("base", pa.list_(_SPAN)), ("slots", pa.list_(_SLOT)),
])
_FOUND_SQL = (
    "row bigint, doc_id bigint, base_sha256 string, "
    "base array<struct<kind:int,start:bigint,end:bigint>>, "
    "slots array<struct<kind:int,start:bigint,end:bigint,value:string,seed:boolean,"
    "patterns:array<string>>>"
)


def text_slots(text: str, base: list[Span]) -> list[dict]:
    """All slots of a text, seeds among them."""
    out = []
    for seed, spans in ((True, base), (False, loose_spans(text, base))):
        for kind, start, end in spans:
            out.append({
                "kind": kind, "start": start, "end": end, "seed": seed,
                "value": normal_value(kind, text[start:end]), "patterns": patterns(text, start, end),
            })
    return out


def _scanned(docs: DataFrame) -> DataFrame:
    """One row a document: its number, base spans and slots."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(*column_lists(batch, ["doc_id", "text"])):
                text = text or ""
                base = base_spans(text)
                slots = text_slots(text, base) if base or "@" in text or _HAS_DIGIT.search(text) \
                    or _MARK.search(text) else []
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((number, doc_id, digest, [s._asdict() for s in base], slots))
                number += 1
            columns = list(zip(*rows)) if rows else [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, _FOUND_SQL)


def _salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Join rows to one row a key when one key may have most of the rows."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("_salt", salt).join(
        few.withColumn("_salt", every), [*keys, "_salt"]).drop("_salt")


def _links(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct links (pattern, kind, value, seed), and the candidates (kind, value) that equal seeds."""
    slots = scanned.select(F.explode("slots").alias("s")).select("s.*")
    links = checkpointed(
        slots.select(F.explode("patterns").alias("pattern"), "kind", "value", "seed")
        .groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    )
    known = (
        slots.where(F.col("kind") != OTHER).groupBy("kind", "value")
        .agg(F.max("seed").alias("seed"), F.min("seed").alias("all_seeds"))
        .where("seed and not all_seeds").select("kind", "value")
    )
    return links, known


def score_patterns(links: DataFrame, accepted: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns, given candidates (kind, value, score)."""
    scored = _salted_join(
        links.where(~F.col("seed") & (F.col("kind") != OTHER)), accepted, ["kind", "value"], "pattern"
    ).groupBy("pattern", "kind").agg(F.sum("score").alias("learned"))
    kinds = links.groupBy("pattern", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
    totals = kinds.groupBy("pattern").agg(F.sum("n").alias("total"))
    summed = kinds.where(F.col("seeds") >= SUPPORT).join(totals, "pattern").join(
        scored, ["pattern", "kind"], "left")
    confidence = (F.col("seeds") + F.coalesce("learned", F.lit(0.0))) / (F.col("total") + 1)
    return summed.select("pattern", "kind", confidence.alias("confidence")).where(
        F.col("confidence") >= CONFIDENT)


def score_candidates(links: DataFrame, confident: DataFrame) -> DataFrame:
    """(kind, value, score) of the candidates that their confident patterns accept."""
    candidates = links.where(~F.col("seed") & (F.col("kind") != OTHER))
    missed = F.sum(F.log1p(-F.col("confidence")))
    return (
        _salted_join(candidates, confident, ["pattern", "kind"], "value")
        .groupBy("kind", "value").agg((1 - F.exp(missed)).alias("score"))
        .where(F.col("score") >= CONFIDENT)
    )


def accepted_candidates(links: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, value, score) of the candidates that the graph or a seed of the same value accepts."""
    equal = checkpointed(known.select("kind", "value", F.lit(1.0).alias("score")))
    accepted, seen = equal, None
    for _ in range(ROUNDS):
        found = score_candidates(links, score_patterns(links, accepted))
        accepted = checkpointed(
            found.unionByName(equal).groupBy("kind", "value").agg(F.max("score").alias("score")))
        state = tuple(accepted.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("kind", "value"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
    return accepted


def find_identifiers(docs: DataFrame) -> DataFrame:
    """One row per document: numbers of base spans by kind, their digest, and all spans.

    ``n_learned`` is the number of the spans that contexts added.
    """
    scanned = checkpointed(_scanned(docs))
    accepted = accepted_candidates(*_links(scanned))
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    base = scanned.select("row", "doc_id", *counts, "base_sha256", "base")
    if accepted.isEmpty():
        every = base.withColumn("every", F.col("base"))
    else:
        slots = scanned.select("row", F.explode("slots").alias("s")).select("row", "s.*")
        # A document's spans are bounded by its text.
        learned = (
            _salted_join(slots.where(~F.col("seed") & (F.col("kind") != OTHER)),
                         accepted, ["kind", "value"], "row")
            .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("learned"))
        )
        every = base.join(learned, "row", "left").withColumn(
            "every", F.array_sort(F.concat("base", F.coalesce("learned", F.array_except("base", "base")))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform("every", lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return every.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(spans, ",").alias("spans"),
        (F.size("every") - F.size("base")).cast("bigint").alias("n_learned"),
    )
