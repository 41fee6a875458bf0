"""Operators 11 to 13 against plain versions, on the smallest tables and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallylog.llm import (
    alignment, fingerprints, identifiers, language, quality, variants, vectors,
)
from tallylog.llm.common import prepared
from tallylog.llm.queries import QUERIES
from test_llm_operators import CLASHES, DOCS, LONG, ROWS, with_clashes
from test_llm_queries import FOLDER

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def session(spark):
    return prepared(spark)


@pytest.fixture(scope="module")
def edge(session):
    return with_clashes(session.createDataFrame(ROWS, DOCS)).repartition(3)


@pytest.fixture(scope="module")
def empty(session):
    return with_clashes(session.createDataFrame([], DOCS))


def documents(session):
    rows = session.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] for r in rows}


# Operator 11


@given(st.text(alphabet="a.@-+ 0159(),%x:\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert identifiers.written(identifiers.base_spans(text)).split(",") == (plain_base(text) or [""])


def test_base_spans_of_long_runs():
    assert identifiers.base_spans("a" * 300_000 + " " + "1" * 300_000) == []
    assert identifiers.loose_spans("1" * 300_000, []) == [(identifiers.OTHER, 0, 300_000)]


def test_op11(session):
    texts = documents(session)
    found = {r["doc_id"]: r for r in QUERIES["op11_bootstrapped_identifiers"](session, FOLDER).collect()}
    assert found.keys() == texts.keys()
    for doc, text in texts.items():
        base, row = plain_base(text or ""), found[doc]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind in BASE:
            assert row[f"n_{kind}"] == sum(s.startswith(kind) for s in base)
        assert set(base) <= set(filter(None, row["spans"].split(",")))


def test_contexts_find_unseen_identifiers(session):
    said = [(i, f"please call her at +1 (555) 20{i}-45{i} after noon") for i in range(10, 16)]
    said += [(i, f"the order number is 55520{i}45{i} since monday") for i in range(20, 30)]
    said += [
        (40, "please call her at 555-777-1234 after noon"),  # a phone number by its context
        (41, "an order number is 5557771299 since then"),
        (42, "fax 555-777-1234 or write"),  # the same number elsewhere
        (43, "his is 1 (555) 2010-4510 today"),  # the digits of a seed
        (44, "please call her at home after noon"),
    ]
    said += [(70 + i, f"mail to: user{i}@example.com or wait") for i in range(14)]
    said += [(60, "mail to: jane (at) example (dot) org or wait"), (61, "mail to: room 5 or wait")]
    docs = session.createDataFrame(said, "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: r for r in identifiers.find_identifiers(docs).collect()}
    text = dict(said)

    def spans(doc):
        return [text[doc][int(s.split(":")[1]) : int(s.split(":")[2])]
                for s in found[doc]["spans"].split(",") if s]

    assert spans(40) == spans(42) == ["555-777-1234"]
    assert spans(43) == ["1 (555) 2010-4510"]
    assert spans(60) == ["jane (at) example (dot) org"]
    assert [spans(d) for d in (41, 44, 61, *range(20, 30))] == [[]] * 13
    assert found[40]["n_phone"] == 0 and found[40]["n_learned"] == 1
    assert all(found[d]["n_phone"] == 1 for d in range(10, 16))


def plain_scores(links, known):
    """The graph's scores once more, in plain Python."""
    accepted = {(k, v): 1.0 for k, v in known}
    before = None
    for _ in range(identifiers.ROUNDS):
        by_pattern = defaultdict(list)
        for p, k, v, s in links:
            by_pattern[p].append((k, v, s))
        confident = {}
        for p, rows in by_pattern.items():
            for kind in range(4):
                seeds = sum(s for k, _, s in rows if k == kind)
                learned = sum(accepted.get((k, v), 0) for k, v, s in rows if k == kind and not s)
                value = (seeds + learned) / (len(rows) + 1)
                if seeds >= identifiers.SUPPORT and value >= identifiers.CONFIDENT:
                    confident[p, kind] = value
        missed = defaultdict(lambda: 1.0)
        for p, k, v, s in links:
            if not s and k >= 0 and (p, k) in confident:
                missed[k, v] *= 1 - confident[p, k]
        found = {c: 1 - m for c, m in missed.items() if 1 - m >= identifiers.CONFIDENT}
        accepted = {**found, **{(k, v): 1.0 for k, v in known}}
        if accepted.keys() == before:
            break
        before = accepted.keys()
    return accepted


def test_graph_scores(session):
    rng = np.random.default_rng(3)
    rows = {}
    for _ in range(1500):
        place = int(rng.integers(60))
        kind = int(rng.choice([0, 1, 3, -1], p=[0.02, 0.02, 0.94, 0.02])) if place % 2 else int(rng.integers(-1, 4))
        value = int(rng.integers(900))
        rows[f"p{place}", kind, f"v{value}"] = kind >= 0 and value % 8 != 0
    links = [(*k, s) for k, s in rows.items()]
    known = sorted({(k, v) for _, k, v, s in links if k >= 0 and not s})[:5]
    df = session.createDataFrame(links, "pattern string, kind int, value string, seed boolean")
    found = identifiers.accepted_candidates(
        df, session.createDataFrame(known, "kind int, value string"))
    theirs = plain_scores(links, known)
    assert len(theirs) > 20
    assert {(r["kind"], r["value"]): pytest.approx(r["score"]) for r in found.collect()} == theirs


# Operator 12


@given(st.lists(st.integers(0, 80), unique=True), st.lists(st.integers(0, 400), unique=True))
@settings(max_examples=300, deadline=None)
def test_gallop(a, b):
    a, b = sorted(a), sorted(b)
    one, two = alignment.gallop(a, b)
    shared = sorted(set(a) & set(b))
    assert [a[i] for i in one] == shared == [b[j] for j in two]


def plain_alignment(text):
    """Groups and linked pairs with the libraries' own encoding of whole texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    alphabet = alignment.byte_alphabet()
    raw_a = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
    raw_b = []
    for piece in map(b_lib.id_to_piece, b):
        byte = re.fullmatch("<0x(..)>", piece)
        raw_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("\u2581", " ").encode())
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    ends = [np.cumsum(list(map(len, raw))).tolist() for raw in (raw_a, raw_b)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        n, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:n], b[j:m]))
        i, j = n, m
    return groups


def plain_rows(texts):
    every = [plain_alignment(t) or [] for t in texts]
    pairs = [Counter((x, y) for a, b in g for x in a for y in b) for g in every]
    counts = Counter(p for c in pairs for p in c)
    best: dict = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, linked in zip(every, pairs):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
            sum(linked.values()), sum(n for p, n in linked.items() if counts[p] == best[p[0]]),
            sum(n * counts[p] for p, n in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op12(session):
    texts = documents(session)
    found = {r["doc_id"]: r for r in QUERIES["op12_galloping_alignment"](session, FOLDER).collect()}
    assert found.keys() == texts.keys()
    for doc, row in zip(texts, plain_rows(texts.values())):
        assert tuple(found[doc][c] for c in COLUMNS) == row


def test_alignment_edges(session, edge, empty):
    rows = sorted((tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(edge).collect()))
    assert rows == sorted(plain_rows([r[1] for r in ROWS]))
    assert alignment.align_documents(empty).count() == 0
    odd = ["a  b", "x\n\ny", " lead", "trail ", "tab\tx", "日本語 text", "it's 12.5 a\n b", "<s> <|endoftext|> y",
           "\n", "\u2581x a\u2581b", "😀" * 400, "-" * 5000, "\x00x", "A\nB. c,d", "½é", "x\x1cy", ""]
    docs = session.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").coalesce(1)
    found = {r["doc_id"]: r for r in alignment.align_documents(docs).collect()}
    for doc, row in enumerate(plain_rows(odd)):
        assert tuple(found[doc][c] for c in COLUMNS) == row
    counts = {(r["a"], r["b"]): r["documents"] for r in alignment.linked_counts(docs).collect()}
    assert counts == Counter(p for t in odd for p in {
        (x, y) for a, b in plain_alignment(t) or [] for x in a for y in b})


def test_large_groups(monkeypatch):
    found = alignment.aligner(*alignment.default_tokenizers())
    text = "the thermometer\t" * 30 + "😀é" * 50
    first = [(p.tolist(), t.tolist()) for _, p, t in found.align([text])]
    monkeypatch.setattr(alignment, "LISTED", 1)
    again = [(p.tolist(), t.tolist()) for _, p, t in found.align([text])]
    assert first == again and max(first[0][1]) > 1


# Operator 13


def plain_variants(texts):
    counts: Counter = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, shapes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shapes[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for alike in shapes.values():
        for w in alike:
            near[w] |= alike - {w}
    forms = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                forms[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None)
    return out


def variants_of(docs):
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n"))
            for r in variants.spelling_variants(docs).collect()}


def test_op13(session):
    rows = QUERIES["op13_spelling_tiles"](session, FOLDER).collect()
    found = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}
    assert found == plain_variants(documents(session).items()) and len(found) > 100


def test_variants_in_large_keys(session, monkeypatch):
    """Many words of one start and one end, of neighbouring lengths and with chains of forms."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("ab"), int(rng.integers(8, 11)))) for _ in range(300)}
    words |= {"abcdef" + "".join(rng.choice(list("xyz"), 3)) for _ in range(30)} | {"éclairs", "éclair", "eclairs"}
    words |= {"w" * 400, "w" * 399, "w" * 200 + "v" + "w" * 199}
    said = [(i, " ".join([w] * int(5 * 6 ** rng.integers(0, 4)))) for i, w in enumerate(sorted(words))]
    said += [(None, "Éclairs Éclairs"), (None, None), (5, ""), (5, "ABBABBAB " * 40), (7, LONG)]
    docs = with_clashes(session.createDataFrame(said, "doc_id bigint, text string")).repartition(3)
    plain = plain_variants(said)
    assert sum(f is not None for f, *_ in plain.values()) > 20
    assert max(sum(x) for x in [[w != r for w, (_, r, *_) in plain.items()]]) > 20
    assert variants_of(docs) == plain
    monkeypatch.setattr(variants, "TILE", 8)
    assert variants_of(docs) == plain


def test_edges_of_words_and_identifiers(session, edge, empty):
    assert variants_of(edge) == plain_variants([(r[0], r[1]) for r in ROWS])
    assert variants_of(empty) == {} and identifiers.find_identifiers(empty).count() == 0
    rows = identifiers.find_identifiers(edge).collect()
    assert len(rows) == len(ROWS)
    assert {r["base_sha256"] for r in rows if r["spans"] == ""} == {hashlib.sha256(b"").hexdigest()}
    assert set(CLASHES).isdisjoint(rows[0].asDict())


# Mended operators


def test_a_learned_profile_ranks_as_its_text_does(session):
    """Ties are many in a short text; the profile of one text is at distance 0 from it."""
    text = "abc abd über die Brücke"
    learned = language.learn_profiles(
        session.createDataFrame([(text, "de")], "text string, lang string"))
    assert learned.predict(text) == ("de", 1.0)
    codes = language.ranked(text, language.DEPTH)
    ranks = dict(zip(learned.codes.tolist(), learned.ranks[:, 0].tolist()))
    assert ranks == {int(c): i for i, c in enumerate(codes)}


def test_containment_is_open_where_a_sketch_is_too_small():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(words)
    open_, told = 0, []
    for _ in range(200):
        at = int(rng.integers(4900))
        found = fingerprints.containment(
            fingerprints.sketch(" ".join(words[at : at + 14])), fingerprints.sketch(long))
        open_ += found is None
        told += [found] if found is not None else []
    assert set(told) == {1.0} and 20 < open_ < 100


def test_repeated_rows_of_one_id_teach_once(session):
    labels = session.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    rows = [(i, f"good words here {i}" if i % 2 else f"bad bad bad {i}") for i in range(12)]
    once = session.createDataFrame(rows, "doc_id bigint, text string")
    many = session.createDataFrame(rows + rows[2:3] * 40, "doc_id bigint, text string").repartition(3)
    (a, bias_a), (b, bias_b) = (quality.train_quality(d, labels) for d in (once, many))
    assert bias_a == bias_b and (a.value == b.value).all()


def test_probes_stay_small_with_many_lists():
    import tracemalloc

    rng = np.random.default_rng(2)
    sample = vectors.unit(rng.normal(size=(1100, 512)))
    tracemalloc.start()
    known = vectors.Quantizer(sample, 1024)
    near, _, _ = known.encode(sample[:200])
    probed = known.probes(sample[:200], near, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert probed.shape == (200, 1024) and probed[np.arange(200), near].all()
    assert peak < 500e6
    apart = np.sqrt(((known.centres[:5, None] - known.centres[None]) ** 2).sum(-1))
    assert np.allclose(known.apart[:5], apart, atol=1e-6)
