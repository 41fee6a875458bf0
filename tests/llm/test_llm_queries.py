"""The registered queries on the smallest tables against DuckDB or a plain version in Python."""

import hashlib
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tallylog.llm import fingerprints, pieces, quality, vectors
from tallylog.llm.common import ascii_words, jaccard, prepared, shingle_set
from tallylog.llm.queries import ORACLES, QUERIES
from workload.compare import _rows, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, text from documents order by doc_id").fetchall())


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]


def is_held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


class Groups:
    """Smallest reachable member of each node."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        low, high = sorted((self.find(a), self.find(b)))
        self.up[high] = low


def near_groups(texts, size):
    sets = {d: shingle_set(ascii_words(t), size) for d, t in texts.items()}
    groups, docs = Groups(texts), sorted(texts)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both, either = jaccard(sets[a], sets[b])
            if either and 100 * both >= 80 * either:
                groups.join(a, b)
    return sets, groups


def library_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = known.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)
    return {d: np.array([*e.ids, end], "<u4") for d, e in zip(texts, found)}


def test_all_are_registered():
    import __spark_entry__

    numbers = {n.split("_")[0] for n in QUERIES if n != "pipeline"}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in QUERIES
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(k for k, v in ORACLES.items() if v))
def test_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_op1(spark, texts):
    found = {r["doc_id"]: r for r in rows_of(spark, "op1_scaled_sketch")}
    assert found.keys() == texts.keys()
    order = sorted(texts)
    for place, doc in enumerate(order):
        text, following = texts[doc] or "", texts[order[(place + 1) % len(order)]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, after = map(fingerprints.sketch, (text, changed, following))
        row = found[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["fingerprint"] == fingerprints.as_text(own)
        assert row["edited_fingerprint"] == fingerprints.as_text(other)
        assert row["near_edited"] == pytest.approx(fingerprints.likeness(own, other))
        assert row["near_next"] == pytest.approx(fingerprints.likeness(own, after))


def test_op2(spark, con):
    truth = dict(con.execute("select doc_id, lang from documents").fetchall())
    found = rows_of(spark, "op2_language_profiles")
    assert {r["doc_id"] for r in found} == set(truth)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(held) >= 0.97 * len(held)


def test_op3(spark, texts):
    model = pieces.piece_model(pieces.default_model())
    for row in rows_of(spark, "op3_piece_viterbi"):
        ids, score = model.encode(texts[row["doc_id"]])
        assert row["decoded_equal"]
        assert (row["n_ids"], row["score"]) == (len(ids), score)
        assert row["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())


def test_op4(spark, texts):
    ids = library_ids(texts, 2)
    found = rows_of(spark, "op4_first_fit_packing")
    fill, seen = {}, {d: 0 for d in texts}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), r["doc_tokens"]) == (r["length"], len(ids[r["doc_id"]]))
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(i) for d, i in ids.items()}
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 4096
    assert len(fill) <= 1.05 * sum(fill.values()) / 4096 + 1


def test_op6(spark):
    """Held-out accuracy; the smallest tables have only 19 labelled held-out documents."""
    folder = os.environ.get("TEST_SF_LABELS", "/root/testdata/sf0.01")
    labels = connect(folder).execute("select doc_id, quality from labels where quality is not null")
    truth = dict(labels.fetchall())
    found = [r.asDict() for r in QUERIES["op6_quality_ftrl"](spark, folder).collect()]
    assert all(r["held_out"] == is_held_out(r["doc_id"]) for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    held = [r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(held) >= 0.95 * len(held)


def test_op7_on_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    rows = []
    for i in range(900):
        x = centres[i % 60] + (0.12 + 0.1 * (i % 3)) * rng.normal(size=24)
        rows.append((i, (rows[i - 60][1] if i % 7 == 0 and i >= 60 else [float(np.float32(v)) for v in x]), i % 4))
    df = prepared(spark).createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df.repartition(4)).collect()}
    x = vectors.unit(r[1] for r in rows)
    labels = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(linked, False)
    groups = Groups(range(len(rows)))
    for a, b in zip(*np.nonzero(linked)):
        groups.join(int(a), int(b))
    assert linked.sum() > 300
    for i in range(len(rows)):
        assert found[i]["n_links"] == linked[i].sum()
        assert found[i]["component_id"] == groups.find(i)
        assert found[i]["kept"] == (groups.find(i) == i)


def test_op8(spark, texts):
    found = {r["doc_id"]: r for r in rows_of(spark, "op8_token_files")}
    start = 0
    for doc, ids in library_ids(texts, 1).items():
        assert (found[doc]["start"], found[doc]["n_tokens"]) == (start, len(ids))
        assert found[doc]["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_op9(spark, texts):
    sets, groups = near_groups(texts, 4)
    found = {r["doc_id"]: r for r in rows_of(spark, "op9_circulant_minhash")}
    assert found.keys() == texts.keys()
    for doc, row in found.items():
        assert row["n_shingles"] == len(sets[doc])
        assert row["component_id"] == groups.find(doc)
        assert row["kept"] == (groups.find(doc) == doc)


def test_pipeline(spark, con, texts):
    """Each stage's decisions once more in plain Python, on what the stage before kept."""
    labels = con.execute("select doc_id, quality from labels where quality is not null").fetchall()
    session = prepared(spark)
    order = {
        r[0]: r[1] for r in session.createDataFrame([(d,) for d in texts], "doc_id bigint")
        .selectExpr("doc_id", "xxhash64(doc_id, 'quality')").collect()
    }
    config = quality.FtrlConfig()
    rows = [(order[d], texts[d], float(q)) for d, q in labels if not is_held_out(d)]
    weights, bias = quality.train_rows(rows, config)
    good = {d: t for d, t in texts.items()
            if quality.score_features(*quality.features(t, config.bits), weights, bias) >= quality.GOOD}
    known = {d: t for d, t in good.items() if any(c.isalpha() for c in t or "")}
    _, groups = near_groups(known, 5)
    kept = {d for d in known if groups.find(d) == d}

    docs = session.read.parquet(f"{FOLDER}/documents.parquet")
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(session, now, FOLDER)
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert seen == [set(good), set(known), kept, kept]
    assert {r["doc_id"] for r in rows_of(spark, "pipeline")} == kept
