"""License scans: normalised text against license templates by Dice coefficient over word bigrams.

Words are runs of a-z and 0-9 after lower-casing A-Z. A text is compared as a whole, by paragraph
(split at an empty line) and by line, and by every window of its words that is as long as a template,
so a notice is found wherever it stands: wrapped, or between other sentences. The Dice coefficient of
two bigram sets of sizes a and b is at most 2 min(a, b) / (a + b), so with the least coefficient t
only templates of size a t / (2 - t) to a (2 - t) / t can match; templates are sorted by size and the
others are never looked at. What is left must share a bigram. As a match shares at least
a t / (2 - t) bigrams with a template of size a, units and windows are only looked at for templates
of which the whole text has so many.

Neighbours. Licenses of one family differ in a word or a number. A match must have the template's
version numbers, and of the words that tell licenses apart (``TELLING``) exactly the template's.
Of matches that overlap in the text only the best stays, by coefficient, then license id, then
smaller unit. A license that others contain yields to them (``YIELDS``): the two-clause BSD to the
three-clause one, and "All rights reserved." to any license beside it.

``scan_sql`` states the whole units over ``TEMPLATES`` and what yields; the scan also has ``NOTICES``,
a rule's templates of the Creative Commons and GNU families, and windows, and so can find more.
Whole license texts are taken from files by ``read_templates``, since only short notices are kept here.

Each document is scanned where it lies, in Arrow batches; nothing is moved. The templates are a
parameter and go along with the function; they are short texts in a number that does not grow with
the data.

Edge cases: null and empty texts and units of one word have no bigram and match nothing. Repeated
rows are scanned each. Extra columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.llm.common import column_lists

#: Least Dice coefficient of a match.
LEAST = 0.8

#: Short public notices by which licenses are named in texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ],
    "Proprietary": ["All rights reserved."],
}

#: Whole short licenses by their paragraphs, standard headers and common sentences.
NOTICES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "This project is licensed under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written "
        "permission.",
        "This project is licensed under the BSD 3-Clause License.",
    ],
    "BSD-2-Clause": ["This project is licensed under the BSD 2-Clause License."],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the "
        "\"License\"); you may not use this file except in compliance with the License.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ],
}
#: The parts of Creative Commons names, and the GNU licenses with their versions.
CC_PARTS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ("", "NC", "SA", "ND", "NC-SA", "NC-ND")
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
GNU = {
    "GPL": ("General Public License", ("2", "3")),
    "LGPL": ("Lesser General Public License", ("2.1", "3")),
    "AGPL": ("Affero General Public License", ("3",)),
}


def families() -> dict[str, list[str]]:
    """The usual sentences of the Creative Commons and GNU licenses, for all kinds and versions."""
    out = {}
    for kind, (version, world) in product(CC_KINDS, CC_VERSIONS.items()):
        parts = kind.split("-") if kind else []
        long = "-".join(["Attribution", *[CC_PARTS[p] for p in parts]])
        short = "-".join(["BY", *parts])
        out[f"CC-{short}-{version}"] = [
            f"This work is licensed under a Creative Commons {long} {version} {world} License.",
            f"Licensed under the Creative Commons {long} {version} license.",
            f"Licensed under CC {short} {version}.",
        ]
    for short, (long, versions) in GNU.items():
        for version in versions:
            whole = version if "." in version else f"{version}.0"
            out[f"{short}-{whole}"] = [
                f"This work is licensed under the GNU {long}, version {version}.",
                f"Licensed under the GNU {long} v{whole}.",
                f"Released under the {short} v{version} license.",
            ]
    return out


def merged(*groups: dict[str, list[str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for group in groups:
        for name, texts in group.items():
            held = out.setdefault(name, [])
            held += [t for t in texts if t not in held]
    return out


#: What a scan compares with.
ALL = merged(TEMPLATES, NOTICES, families())

#: Words that tell neighbouring licenses apart, by their one meaning.
TELLING = {
    "affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser", "nc": "nc",
    "noncommercial": "nc", "sa": "sa", "sharealike": "sa", "nd": "nd", "noderivatives": "nd",
    "noderivs": "nd",
}
#: Licenses that give way to the named ones in the same text, or to any.
YIELDS: dict[str, set[str] | None] = {"BSD-2-Clause": {"BSD-3-Clause"}, "Proprietary": None}


def read_templates(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Whole license texts as templates: a file ``<license id>.txt`` each, few and small."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1), "value")
    return {name: [text] for name, text in files.collect()}


_WORDS = re.compile(rb"[a-z0-9]+")
#: Smaller units first, as ties are settled.
UNITS = ("line", "paragraph", "text", "window")


_NUMBER = re.compile(rb"[a-z]*?v?([0-9]{1,2})")


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    words = _WORDS.findall(text.lower())
    return set(zip(words, words[1:]))


def telling(words: list[bytes]) -> tuple[set[str], set[bytes]]:
    """The words that tell licenses apart, and the version numbers; a zero says nothing."""
    names = {TELLING[w.decode()] for w in words if w.decode() in TELLING}
    if any(w.startswith((b"lgplv", b"agplv")) for w in words):
        names |= {"affero" if w.startswith(b"a") else "lesser"
                  for w in words if w.startswith((b"lgplv", b"agplv"))}
    numbers = {m[1].lstrip(b"0") for w in words if (m := _NUMBER.fullmatch(w))}
    return names, numbers - {b""}


class Template(NamedTuple):
    size: int
    name: str
    grams: set
    #: Bigrams of a window, with repeated ones.
    span: int
    names: set
    numbers: set

    def told(self, words: list[bytes]) -> bool:
        """Whether these words are this license's and not a neighbour's."""
        names, numbers = telling(words)
        return names == self.names and self.numbers <= numbers


class Match(NamedTuple):
    """Best first when sorted."""

    less: float
    name: str
    place: int
    start: int
    end: int


class Templates:
    """Templates sorted by their number of bigrams."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.found = sorted((
            Template(len(grams), name, grams, len(words) - 1, *telling(words))
            for name, texts in templates.items()
            for text in texts
            for words in [_WORDS.findall(text.encode().lower())]
            if (grams := set(zip(words, words[1:])))
        ), key=lambda t: (t.size, t.name))
        self.sizes = [t.size for t in self.found]
        self.least = least
        self.known = set().union(*[t.grams for t in self.found]) if self.found else set()
        # A unit under or over these sizes has no candidate.
        # Bounds leave room for rounding; the coefficient itself decides.
        self.ratio = (2 - least) / least * (1 + 1e-9)
        self.smallest = min(self.sizes, default=1) / self.ratio
        self.largest = max(self.sizes, default=0) * self.ratio

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(license, Dice) of the templates that a unit of these words matches."""
        grams = set(zip(words, words[1:]))
        n = len(grams)
        if not n or not self.smallest <= n <= self.largest:
            return []
        shared = grams & self.known
        if not shared:
            return []
        low = bisect_left(self.sizes, n / self.ratio)
        high = bisect_right(self.sizes, n * self.ratio)
        out = []
        for template in self.found[low:high]:
            dice = 2.0 * len(shared & template.grams) / (n + template.size)
            if dice >= self.least and template.told(words):
                out.append((template.name, dice))
        return out

    def windows(self, words: list[bytes], grams: list[tuple], template: Template) -> list[Match]:
        """The best window of each stretch of windows that match, at any place."""
        found: list[Match] = []
        held, both, span = {}, 0, template.span
        for at, gram in enumerate(grams):
            held[gram] = held.get(gram, 0) + 1
            if held[gram] == 1:
                both += gram in template.grams
            if at >= span:
                gone = grams[at - span]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                    both -= gone in template.grams
            if at >= span - 1 and both:
                dice = 2.0 * both / (len(held) + template.size)
                start = at - span + 1
                if dice >= self.least and template.told(words[start : at + 2]):
                    match = Match(-dice, template.name, UNITS.index("window"), start, at + 2)
                    if found and start < found[-1].end:
                        found[-1] = min(found[-1], match)
                    else:
                        found.append(match)
        return found

    def scan(self, text: bytes | None) -> tuple[list[str], str | None, float | None, str | None]:
        """All licenses of a text, and the best one with its coefficient and unit."""
        if not text:
            return [], None, None, None
        words = _WORDS.findall(text.lower())
        grams = list(zip(words, words[1:]))
        shared = self.known.intersection(grams)
        within = shared and [
            t for t in self.found if len(shared & t.grams) * self.ratio >= t.size]
        if not within:
            return [], None, None, None
        found = [m for t in within for m in self.windows(words, grams, t)]
        cut = {"line": text.split(b"\n"), "paragraph": text.split(b"\n\n"), "text": [text]}
        for place, kind in enumerate(UNITS[:3]):
            if place and len(cut[kind]) == len(cut[UNITS[place - 1]]):
                continue  # the same units once more
            start = 0
            for unit in cut[kind]:
                part = _WORDS.findall(unit.lower())
                found += [Match(-dice, name, place, start, start + len(part))
                          for name, dice in self.matches(part)]
                start += len(part)
        return decided(found)


def decided(found: list[Match]) -> tuple[list[str], str | None, float | None, str | None]:
    """What stays of the matches of one text when overlapping ones compete."""
    kept: list[Match] = []
    for match in sorted(found):
        if all(match.name == k.name or match.end <= k.start or k.end <= match.start for k in kept):
            kept.append(match)
    names = {k.name for k in kept}
    gone = {n for n in names if n in YIELDS and (
        names & YIELDS[n] if YIELDS[n] is not None else names - {n})}
    best = next((k for k in kept if k.name not in gone), None)
    if best is None:
        return [], None, None, None
    return sorted(names - gone), best.name, -best.less, UNITS[best.place]


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] = ALL, least: float = LEAST
) -> DataFrame:
    """Per row of ``docs``: doc_id, licenses, and the best license with its Dice and unit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            ids, texts = column_lists(batch, ["doc_id", "text"])
            names, best, dice, unit = zip(*map(known.scan, texts)) if texts else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(names, pa.list_(pa.string())),
                    pa.array(best, pa.string()), pa.array(dice, pa.float64()),
                    pa.array(unit, pa.string()),
                ],
                ["doc_id", "licenses", "license", "dice", "unit"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(
        scan,
        "doc_id bigint, licenses array<string>, license string, dice double, unit string",
    )


def scan_sql(templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> str:
    """The scan of table documents as DuckDB SQL; ``licenses`` is joined with commas."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = (
        "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    )
    words = f"regexp_extract_all(translate(t, '{upper}', '{upper.lower()}'), '[a-z0-9]+')"
    rows = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''"))
        for name, texts in sorted(templates.items()) for text in texts
    )
    return f"""
with template as (
  select name, {grams} as g from (select name, {words} as w from (values {rows}) v(name, t))),
unit as (
  select doc_id, 0 as place, unnest(string_split(text, chr(10))) as t from documents
  union all
  select doc_id, 1, unnest(string_split(text, chr(10) || chr(10))) from documents
  union all
  select doc_id, 2, text from documents),
cut as (
  select doc_id, place, {grams} as g from (select doc_id, place, {words} as w from unit)
  where len(w) > 1),
alike as (
  select doc_id, place, name,
    2.0 * len(list_intersect(c.g, t.g)) / (len(c.g) + len(t.g)) as dice
  from cut c join template t on len(t.g) between len(c.g) * {least} / (2 - {least}) and len(c.g) * (2 - {least}) / {least}),
held as (
  select *, count(distinct name) over (partition by doc_id) as names,
    max(case when name = 'BSD-3-Clause' then 1 else 0 end) over (partition by doc_id) as bsd_3
  from alike where dice >= {least}),
best as (
  select doc_id, arg_min(struct_pack(name := name, dice := dice, place := place),
      struct_pack(d := -dice, n := name, p := place)) as b,
    array_to_string(list_sort(list(distinct name)), ',') as licenses
  from held where not (name = 'Proprietary' and names > 1) and not (name = 'BSD-2-Clause' and bsd_3 = 1)
  group by doc_id)
select d.doc_id, coalesce(licenses, '') as licenses, b.name as license, cast(b.dice as double) as dice,
  case b.place when 0 then 'line' when 1 then 'paragraph' when 2 then 'text' end as unit
from documents d left join best using (doc_id)
"""
