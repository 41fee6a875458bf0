"""Every operator on nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallylog.llm import (
    binary, chat, components, fingerprints, language, licenses, minhash, packing, pieces, quality,
    vectors,
)
from tallylog.llm.common import prepared
from tallylog.llm.tokens import default_tokenizer, encoder

PROSE = "the cat sat on the mat and saw that the dog was not there at all today"
LONG = " ".join(f"word{i} and" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "s", 70), (2, PROSE, "en", "s", 70), (2, PROSE, "en", "s", 70),
    (3, None, None, None, None), (4, "", "en", None, 0), (5, "   ", "en", "s", 3),
    (6, LONG, "en", "s", len(LONG)), (7, LONG + " end", "en", None, None),
    (8, "der hund war nicht da und die katze auch nicht", "de", "s", None),
    (None, "a row without a number", "en", "s", 1), (10, "123 456", "en", "s", 7),
    (11, "one", "en", "s", 3), (12, "Released under the MIT License.", "en", "s", 31),
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHES = ["id", "score", "label", "_label", "held_out", "key", "n", "component", "digest", "part"]


@pytest.fixture(scope="module")
def session(spark):
    return prepared(spark)


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


@pytest.fixture(scope="module")
def docs(session):
    return with_clashes(session.createDataFrame(ROWS, DOCS)).repartition(3)


@pytest.fixture(scope="module")
def empty(session):
    return with_clashes(session.createDataFrame([], DOCS))


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_fingerprints(docs, empty):
    found = by_id(fingerprints.compare_neighbours(docs))
    assert len(fingerprints.compare_neighbours(docs).collect()) == len(ROWS)
    assert found[1]["fingerprint"] == found[2]["fingerprint"] != ""
    assert found[1]["near_next"] == 1.0
    assert found[3]["fingerprint"] == found[4]["fingerprint"] == ""
    assert (found[3]["n_chars"], found[3]["near_next"], found[3]["near_edited"]) == (0, 1.0, 1.0)
    # The last document is followed by the first, the one without a number.
    last = fingerprints.edited_text(ROWS[-1][1], "a row without a number")
    assert found[12]["edited_fingerprint"] == fingerprints.as_text(fingerprints.sketch(last))
    assert fingerprints.compare_neighbours(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert by_id(fingerprints.fingerprints(docs))[6]["fingerprint"] == found[6]["fingerprint"]
    one = fingerprints.compare_neighbours(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_language(docs, empty):
    profiles = language.learn_profiles(docs)
    assert profiles.languages == ["de", "en"]
    found = by_id(language.predict_languages(docs, profiles))
    assert len(found) == 12
    for unknown in (3, 4, 5, 10):
        assert (found[unknown]["lang_pred"], found[unknown]["score"]) == ("und", 0.0)
    assert found[8]["lang_pred"] == "de" and found[1]["lang_pred"] == "en"
    assert 0 <= min(f["score"] for f in found.values())
    none = language.learn_profiles(empty)
    assert {r["lang_pred"] for r in language.predict_languages(docs, none).collect()} == {"und"}
    assert language.predict_languages(empty, profiles).count() == 0
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 10}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_pieces(docs, empty):
    found = by_id(pieces.round_trip(docs))
    assert all(f["decoded_equal"] for f in found.values())
    assert found[3]["n_ids"] == found[4]["n_ids"] == 0
    assert found[1]["ids_crc32"] == found[2]["ids_crc32"]
    decoded = by_id(pieces.decode_pieces(pieces.encode_pieces(docs)))
    assert decoded[6]["text"] == LONG and decoded[3]["text"] == ""
    assert pieces.round_trip(empty).count() == 0


def test_packing(docs, empty):
    found = packing.pack_documents(docs, group_rows=4).collect()
    ids = [np.append(a, np.uint32(2)) for a in encoder(default_tokenizer()).encode(
        [r[1] for r in ROWS])]
    assert sum(f["length"] for f in found) == sum(map(len, ids))
    number = {r[0]: i for i, r in enumerate(ROWS)}
    for f in found:
        part = ids[number[f["doc_id"]]][f["start"] : f["start"] + f["length"]]
        assert f["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
        assert f["doc_tokens"] == len(ids[number[f["doc_id"]]])
    bins: dict = {}
    for f in sorted(found, key=lambda f: (f["sequence_id"], f["offset"])):
        assert f["offset"] == bins.get(f["sequence_id"], 0)
        bins[f["sequence_id"]] = f["offset"] + f["length"]
    assert sorted(bins) == list(range(len(bins))) and max(bins.values()) <= 4096
    assert packing.pack_documents(empty).count() == 0


def test_chat(session):
    said = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 0, "user", "hi"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "no"),
        (6, 0, None, "x"), (7, 0, "unknown", "x"), (8, 0, "user", None), (9, 0, None, None),
        (None, 0, "user", "lost"), (10, None, "user", "lost"),
        (11, 0, "b", "same turn"), (11, 0, "a", "same turn"), (12, 5000, "user", "far"),
        (12, -3, "user", "early"),
    ]
    turns = with_clashes(session.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"))
    found = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    assert set(found) == {2, 4, 6, 8, 9, 11, 12}
    assert found[2]["text"] == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
        "<|im_start|>user\nmore<|im_end|>\n"
    )
    assert (found[4]["copies"], found[6]["copies"], found[2]["n_turns"]) == (2, 2, 3)
    assert found[8]["text"] == "<|im_start|>user\n<|im_end|>\n"
    assert found[11]["text"].startswith("<|im_start|>a\n")
    assert found[12]["text"].index("early") < found[12]["text"].index("far")
    assert chat.format_conversations(turns.where("false")).count() == 0
    plan = chat.format_conversations(turns)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_quality(session, docs, empty):
    labels = session.createDataFrame(
        [(i, int(i != 8), 0) for i in range(1, 13)] + [(1, 0, 0), (3, None, None), (None, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    model = quality.train_quality(docs, with_clashes(labels))
    found = by_id(quality.score_documents(docs, model))
    assert len(found) == 12
    assert all(0 <= f["score"] <= 1 and f["predicted"] == (f["score"] >= 0.3) for f in found.values())
    assert found[3]["score"] == found[4]["score"] == found[5]["score"]
    assert found[1]["score"] == found[2]["score"]
    untaught = quality.train_quality(docs, labels.where("false"))
    assert {r["score"] for r in quality.score_documents(docs, untaught).collect()} == {0.5}
    assert quality.score_documents(empty, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_vectors(session):
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2),
        (5, [0.0, 1.0], 1), (6, [0.0, 0.0], 1), (7, None, 1), (8, [float("nan"), 1.0], 1),
        (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [], 1), (12, [1.0, 0.0, 0.0], 1),
        (13, [float("inf"), 1.0], 1), (13, [0.0, 1.0], 1), (None, [0.0, 1.0], 1),
    ]
    df = with_clashes(session.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    found = vectors.near_duplicate_vectors(df).collect()
    assert len(found) == len(rows)
    got = sorted((tuple(r) for r in found), key=repr)
    linked = {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (5, 2, 5, True),
              (13, 2, 5, False), (None, 2, 5, True)}
    alone = {(i, 0, i, True) for i in (4, 6, 7, 8, 9, 10, 11, 12, 13)}
    assert set(got) == linked | alone
    assert vectors.near_duplicate_vectors(df.where("false")).count() == 0
    assert vectors.near_duplicate_vectors(df.where("vec_id = 6")).count() == 1


def test_token_files(docs, empty):
    manifest = binary.write_tokens(docs).cache()
    found = sorted(binary.read_tokens(manifest).collect(), key=lambda r: r["start"])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = encoder(default_tokenizer()).encode([r[1] for r in order])
    start = 0
    for row, own, read in zip(order, ids, found, strict=True):
        own = np.append(own, np.uint32(1)).astype("<u4")
        assert tuple(read) == (row[0], start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert binary.token_files(empty).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        binary.write_tokens(docs, dtype="u1").count()


def test_minhash(docs, empty):
    found = minhash.near_duplicates(docs, 4).collect()
    assert len(found) == len(ROWS)
    of = {r["id"]: r for r in found}
    assert of[2]["component_id"] == 1 and not of[2]["kept"]
    assert of[7]["component_id"] == 6 and not of[7]["kept"]
    for alone in (3, 4, 5):
        assert (of[alone]["n_shingles"], of[alone]["component_id"], of[alone]["kept"]) == (0, alone, True)
    assert of[None]["component_id"] is None and of[None]["kept"]
    assert of[11]["n_shingles"] == 1
    assert minhash.near_duplicates(empty, 4).count() == 0
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["None", "1", "3", "4", "5", "6", "8", "10", "11", "12"])
    twice = docs.where("doc_id = 11").unionByName(docs.where("doc_id = 11"))
    assert minhash.keep_first(twice).count() == 1


def test_large_buckets_lose_no_link(session):
    source = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(source[: i % 190] + [f"new{i}"] + source[i % 190 + 1 :])) for i in range(300)]
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(1000 + i, shared + " " + " ".join(f"own{i}x{j}" for j in range(40))) for i in range(200)]
    found = minhash.near_duplicates(session.createDataFrame(rows, "doc_id bigint, text string"), 4)
    of = {r["id"]: r["component_id"] for r in found.collect()}
    assert {of[i] for i in range(300)} == {0}
    assert all(of[1000 + i] == 1000 + i for i in range(200))


def test_pairs_in_a_crowd_with_a_passage_are_all_found(session):
    # Every two of the crowd are 0.78 alike by the passage, the planted pairs 0.80 to 0.83.
    passage = " ".join(f"s{i}" for i in range(222))
    rows = [(i, passage + "".join(f" own{i}x{j}" for j in range(31))) for i in range(1000)]
    for i in range(0, 200, 2):
        same = 4 + i % 5 % 4
        rows[i + 1] = (i + 1, passage + "".join(
            f" own{i + (j >= same)}x{j}" for j in range(31)))
    found = minhash.near_duplicates(session.createDataFrame(rows, "doc_id bigint, text string"), 4)
    of = {r["id"]: r["component_id"] for r in found.collect()}
    assert sum(of[i + 1] == i for i in range(0, 200, 2)) == 100
    assert all(of[i] == i for i in of if i >= 200 or i % 2 == 0)


def test_texts_of_frequent_shingles_only_lose_no_link(session):
    # Six of 40 paragraphs each: no shingle is rare, and no component has half of a bucket.
    import random

    deal = random.Random(1)
    paragraphs = [" ".join(f"p{p}w{i}" for i in range(25)) for p in range(40)]
    start = " ".join(f"s{i}" for i in range(300))
    rows = [(i, " ".join([start] + [paragraphs[p] for p in sorted(deal.sample(range(40), 6))]))
            for i in range(400)]
    found = minhash.near_duplicates(session.createDataFrame(rows, "doc_id bigint, text string"), 4)
    of = {r["id"]: r["component_id"] for r in found.collect()}
    from tallylog.llm.common import ascii_words, jaccard, shingle_set

    sets, root = [shingle_set(ascii_words(t), 4) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = jaccard(sets[i], sets[j])
            if 100 * both >= 80 * either and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert of == dict(enumerate(root))
    assert 40 < len(set(root)) < len(rows)


def test_components(session):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (50, 100)]
    found = components.components(session.createDataFrame(links, "a bigint, b bigint"), "a", "b")
    of = {r["node"]: r["component"] for r in found.collect()}
    assert of == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50}
    assert components.components(session.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_licenses(docs, empty):
    found = by_id(licenses.scan_licenses(docs))
    assert (found[12]["license"], found[12]["dice"], found[12]["unit"]) == ("MIT", 1.0, "line")
    assert found[12]["licenses"] == ["MIT"] and found[1]["licenses"] == []
    assert found[3]["license"] is None and found[4]["dice"] is None
    assert licenses.scan_licenses(empty).count() == 0


def test_pipeline_stages(session, docs, tmp_path):
    session.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    now = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(session, now, str(tmp_path))
        assert stage(session, now.where("false"), str(tmp_path)).count() == 0
        if number < 3:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        now = session.read.parquet(f"{tmp_path}/{number}")
    assert now.count() > 0
