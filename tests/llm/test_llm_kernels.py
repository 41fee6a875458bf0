"""The operators' inner functions against plain versions, without Spark."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallylog.llm import fingerprints, language, licenses, minhash, packing, pieces, quality, vectors
from tallylog.llm.common import ascii_words, jaccard, shingle_set
from tallylog.llm.tokens import default_tokenizer, encoder

WORDS = st.lists(st.sampled_from(["a", "b", "the", "Éa", "x!!", "§"]), max_size=30)
TEXTS = st.text(
    st.one_of(st.sampled_from(" \n\t'.,!<|>aAeEsStTéÉİΣ1"), st.characters(codec="utf-8")), max_size=40
)


@given(WORDS, st.integers(1, 6))
def test_shingle_set_counts_distinct_runs(words, size):
    found = shingle_set([w.encode() for w in words], size)
    k = min(size, len(words))
    runs = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    assert len(found) == len(runs)
    assert list(found) == sorted(found)


def test_ascii_words_split_and_case():
    assert ascii_words("A\tbÉ c\x0bD") == [b"a", "bÉ c".encode(), b"d"]
    assert ascii_words(None) == ascii_words("") == ascii_words(" \n") == []


@given(st.sets(st.integers(0, 50)), st.sets(st.integers(0, 50)))
def test_jaccard_sizes(a, b):
    one, two = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard(one, two) == (len(a & b), len(a | b))


@settings(deadline=None, max_examples=300)
@given(st.lists(TEXTS, max_size=4))
def test_encoder_equals_the_library_on_whole_texts(texts):
    known = encoder(default_tokenizer())
    assert known.split
    whole = known.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [e.ids for e in whole] == [a.tolist() for a in known.encode(texts)]


def test_encoder_on_added_tokens_and_apostrophes():
    known = encoder(default_tokenizer())
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "It's 'tis don't,'s", "é ̸<", None]
    whole = known.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [e.ids for e in whole] == [a.tolist() for a in known.encode(texts)]


@given(st.lists(st.integers(1, 12), max_size=60))
def test_tournament_tree_is_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 12)
    used: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, u in enumerate(used) if u + lengths[i] <= 12), len(used))
        if at == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (at, used[at])
        used[at] += lengths[i]


@settings(deadline=None)
@given(TEXTS)
def test_pieces_come_back_as_their_text(text):
    model = pieces.piece_model(pieces.default_model())
    assert model.decode(model.encode(text)[0]) == text.replace(pieces.SPACE, " ")


def test_viterbi_finds_the_best_of_all_segmentations():
    model = pieces.piece_model(pieces.default_model())
    score = {p: model.automaton.get(p)[2] for p in model.automaton.keys()}
    for word in ["▁there", "▁nation", "▁été", "▁a☃b"]:
        best = max(
            sum(score.get(word[a:b], model.unknown_score if b - a == 1 else -1e18)
                for a, b in itertools.pairwise((0, *cuts, len(word))))
            for r in range(len(word)) for cuts in itertools.combinations(range(1, len(word)), r)
        )
        assert model._viterbi(word)[1] == best


def test_viterbi_is_never_worse_than_the_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    with open(pieces.default_model(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # search by scores, not by merges
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = pieces.piece_model(pieces.default_model())
    for text in ["Hello world", "the nation of them", "Größe und Maß", "les élèves"]:
        theirs = library.encode(text)
        ours, score = model.encode(text)
        assert score >= sum(library.get_score(i) for i in theirs)
        assert model.decode(ours) == library.decode(theirs) == text


def test_gram_codes_and_ranks():
    def plain(text):
        out = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {word} "
            out += list(word)
            out += [padded[i : i + 2] for i in range(len(padded) - 1)]
            out += [padded[i : i + 3] for i in range(len(padded) - 2)]
        return out

    for text in ["Aba ba", "été, ETE!", "x", "a1b 2 c"]:
        assert len(language.gram_codes(text)) == len(plain(text))
        assert len(set(language.gram_codes(text).tolist())) == len(set(plain(text)))
    assert len(language.gram_codes("12 !")) == len(language.gram_codes(None)) == 0


def test_out_of_place_distance():
    grams = language.ranked("aab aab cab", 300)
    other = language.ranked("xyz", 300)
    rows = [("p", int(g.astype(np.int64)), i) for i, g in enumerate(grams)]
    rows += [("q", int(g.astype(np.int64)), i) for i, g in enumerate(other)]
    profiles = language.Profiles(rows, 300)
    assert profiles.predict("aab aab cab") == ("p", 1.0)
    assert profiles.predict("xyz xyz")[0] == "q"
    assert profiles.predict("kkk") == ("p", 0.0)  # a tie goes to the first name
    assert profiles.predict("123") == profiles.predict(None) == ("und", 0.0)


def test_classifier_learns_a_tail_and_repetition():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    prose = lambda: " ".join(rng.choices(vocabulary, k=60))
    junk = lambda: "%%% ".join(rng.choices(vocabulary, k=60))
    again = lambda: " ".join([rng.choice(vocabulary)] * 60)
    rows = [(i, f(), label) for i, (f, label) in enumerate([(prose, 1), (junk, 0), (again, 0)] * 60)]
    config = quality.FtrlConfig()
    weights, bias = quality.train_rows(rows, config)
    score = lambda t: quality.score_features(*quality.features(t, 18), weights, bias)
    assert min(score(prose()) for _ in range(30)) > 0.5
    assert max(max(score(junk()), score(again())) for _ in range(30)) < 0.3
    assert 0 <= score("") == score(None) <= 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
        n = int(len(both) * (1 - share) / 2)
        one, two = both[: len(both) - n], both[n:]
        truth = (len(both) - 2 * n) / len(both)
        agree = (minhash.signature(one) == minhash.signature(two)).mean()
        assert abs(agree - truth) < 0.15
        assert (minhash.band_keys(minhash.signature(one)) == minhash.band_keys(
            minhash.signature(one[::-1]))).all()


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    part, whole = " ".join(words[:1000]), " ".join(words)
    a, b = fingerprints.sketch(part), fingerprints.sketch(whole)
    assert fingerprints.containment(a, b) == 1.0
    assert abs(fingerprints.containment(b, a) - 0.25) < 0.06
    assert (fingerprints.merged(a, b) == b).all()
    assert (fingerprints.from_text(fingerprints.as_text(b)) == b).all()
    tiny = fingerprints.sketch("one two")
    assert len(tiny) == 1 and len(fingerprints.sketch("")) == 0
    assert (fingerprints.merged(tiny, b) == fingerprints.merged(b, tiny)).all()
    assert fingerprints.likeness(tiny[:0], tiny[:0]) == 1.0
    assert fingerprints.likeness(tiny, tiny[:0]) == 0.0
    assert fingerprints.edited_text("abcde", "XY") == "abcXY"
    assert fingerprints.edited_text("abcd", "XYZ") == "abXY"


def plain_license_scan(text, known):
    """The scan over all templates, units and windows, without any bound."""
    words = licenses._WORDS.findall(text.lower())
    units = [(3, i, words[i : i + t.span + 1], t) for t in known.found for i in range(len(words) - t.span)]
    for place, cut in enumerate((b"\n", b"\n\n", None)):
        start = 0
        for unit in text.split(cut) if cut else [text]:
            part = licenses._WORDS.findall(unit.lower())
            units += [(place, start, part, t) for t in known.found]
            start += len(part)
    found = []
    for place, start, part, t in units:
        grams = set(zip(part, part[1:]))
        dice = 2 * len(grams & t.grams) / (len(grams) + t.size) if grams else 0
        if dice >= known.least and t.told(part):
            found.append(licenses.Match(-dice, t.name, place, start, start + len(part)))
    return licenses.decided(found)


def test_license_bounds_lose_no_match():
    known = licenses.Templates(licenses.merged(licenses.TEMPLATES, licenses.NOTICES), 0.8)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for unit in (text, text.upper(), text + " indeed", text.rsplit(" ", 1)[0]):
                whole = f"some words\n{unit}\nmore of it".encode()
                # Of the windows of one place only the best is kept, which changes no decision here.
                assert known.scan(whole) == plain_license_scan(whole, known)
            assert name in known.scan(f"some words\n{text}\nmore".encode())[0]
    assert known.scan(None) == known.scan(b"") == known.scan(b"word") == ([], None, None, None)


#: Notices as authors write them, none of them from the test tables, and the one right license.
WRITTEN = [
    ("This software is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This tool is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Released under the GPL v2 license.", "GPL-2.0"),
    ("It is released under the GPLv3 license, as ever.", None),
    ("Licensed under the GNU General Public License v3.0.", "GPL-3.0"),
    ("Licensed under the GNU Affero General Public License v3.0.", "AGPL-3.0"),
    ("Licensed under the GNU Lesser General Public License v2.1.", "LGPL-2.1"),
    ("Licensed under the GNU Lesser General Public License v3.0.", "LGPL-3.0"),
    ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of "
     "the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n"
     "# of the License, or (at your option) any later version.", "GPL-2.0"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of "
     "the GNU General Public License as published by\n# the Free Software Foundation, either version 3 "
     "of the License, or\n# (at your option) any later version.", "GPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version.", "AGPL-3.0"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU "
     "Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of "
     "the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
     "the License, or (at your option) any later version.", "LGPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you "
     "may not use this file except in compliance with the License.", "MPL-1.1"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
     "International License.", "CC-BY-NC-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("Text: licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
    ("All pictures are licensed under CC BY 4.0, but for the maps.", "CC-BY-4.0"),
    ("All pictures are licensed under CC BY-ND 2.5, but for the maps.", "CC-BY-ND-2.5"),
    ("This project is licensed under the Apache License 2.0.", "Apache-2.0"),
    ("This project is licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("This project is licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Copyright (c) 2019, A. Writer. All rights reserved.\n\nRedistribution and use in source and binary "
     "forms, with or without modification, are permitted provided that the following conditions are met:\n"
     "1. Redistributions of source code must retain the above copyright notice.", "BSD-2-Clause"),
    ("Copyright (c) 2019, A. Writer\nAll rights reserved.\n\nRedistribution and use in source and binary "
     "forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
     "3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse "
     "or promote products derived from\nthis software without specific prior written permission.",
     "BSD-3-Clause"),
    ("Copyright 2024 Example Corp. All rights reserved.", "Proprietary"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
     "all copies.", "ISC"),
    ("The rights of all, reserved or not, under the law of the land.", None),
    ("The commons of a village were for the general public, licensed or not, under version 2 of the map.", None),
]


@pytest.mark.parametrize("text, license", WRITTEN)
def test_neighbouring_licenses_are_told_apart(text, license):
    known = licenses.Templates(licenses.ALL, 0.8)
    for whole in (text, f"First some words of prose.\n\n{text}\n\nMore of it, as it goes on."):
        found = known.scan(whole.encode())
        assert found[:2] == ([license] if license else [], license)
        assert found == plain_license_scan(whole.encode(), known)


def test_notices_are_found_wherever_they_stand():
    import textwrap

    known = licenses.Templates(licenses.ALL, 0.8)
    grant = textwrap.fill(next(t for t in licenses.NOTICES["MIT"] if "sublicense" in t), 60)
    for text in (
        f"Copyright (c) 2024 A. Writer\n\n{grant}\n\nAnd more text.",
        " * " + grant.replace("\n", "\n * "), "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Released under the MIT License. See the file for what else there is to say on it.",
    ):
        assert known.scan(text.encode())[0] == ["MIT"], text
    both = known.scan(b"Licensed under CC BY 4.0.\nThe code: Released under the MIT License.")
    assert both[0] == ["CC-BY-4.0", "MIT"]


def test_whole_license_texts_from_files(spark, tmp_path):
    body = " ".join(f"term{i % 90} of part{i // 7}" for i in range(400))
    (tmp_path / "Own-1.0.txt").write_text(f"Own License version 1. {body}")
    (tmp_path / "Own-2.0.txt").write_text(f"Own License version 2. {body}")
    found = licenses.read_templates(spark, str(tmp_path))
    assert sorted(found) == ["Own-1.0", "Own-2.0"]
    known = licenses.Templates(licenses.merged(licenses.ALL, found), 0.8)
    assert known.scan(f"About.\n\nOwn License version 2. {body}\n".encode())[0] == ["Own-2.0"]


def test_quantizer_bounds_hold():
    rng = np.random.default_rng(3)
    x = vectors.unit(rng.normal(size=(600, 16)))
    y = vectors.unit(x + 0.02 * rng.normal(size=x.shape))
    words = vectors.Quantizer(x, 12)
    near, codes, error = words.encode(y)
    reach = np.sqrt(2 - 2 * 0.98)
    own = words.encode(x)[0]
    probed = words.probes(x, own, reach)
    for i in range(len(x)):
        if x[i] @ y[i] >= 0.98:
            assert probed[i, near[i]]
            square = sum(t[0, c] for t, c in zip(words.table(x[i : i + 1], near[i]), codes[i]))
            assert np.sqrt(max(square, 0)) <= reach + error[i] + vectors.SLACK
