"""Chains of sets, additive fingerprints, part digests and number spelling against plain versions."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylog.functions.canonical import shortest_number, shortest_numbers
from tallylog.operators.multiset import as_text, combined, fingerprint, without
from tallylog.plans.export import part_digests
from tallylog.plans.lifecycle import plan_retirement


def plain_plan(sets, floor, last, chunk):
    """A stretch at a time: the set that reaches furthest from where the one before ended."""
    out, at = [], floor + 1
    while at <= last:
        holding = [(-through, name) for name, start, through in sets if start <= at <= through]
        if not holding:
            break
        reach, name = min(holding)
        end = min(-reach, last)
        out += [(s, min(s + chunk - 1, end), name) for s in range(at, end + 1, chunk)]
        at = -reach + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_the_plan_covers_the_whole_prefix(spark, seed):
    rng = np.random.default_rng(seed)
    sets = [(f"set-{i:03}", int(s), int(s + rng.integers(20, 90))) for i, s in
            enumerate(np.sort(rng.integers(1, 1500, 80)))]
    sets += [("twin-a", 1, 95), ("twin-b", 1, 95), ("wide", 400, 700)]
    catalog = spark.createDataFrame(sets, "set_id string, from_sequence bigint, through_sequence bigint")
    head = 1500
    eligible = spark.range(1, head + 1).select(
        F.col("id").alias("sequence"), (F.col("id") != 1400).alias("eligible"))
    for floor, chunk in ((0, 1000), (30, 17)):
        found = plan_retirement(eligible, catalog, floor, head, chunk).collect()
        rows = sorted((r.from_sequence, r.through_sequence, r.set_id) for r in found)
        assert rows == plain_plan(sets, floor, 1399, chunk) and rows


def test_sets_700_wide_every_600_cover_all(spark):
    sets = [(f"set-{i}", i * 600 + 1, i * 600 + 700) for i in range(40)]
    catalog = spark.createDataFrame(sets, "set_id string, from_sequence bigint, through_sequence bigint")
    eligible = spark.range(1, 20_001).select(F.col("id").alias("sequence"), F.lit(True).alias("eligible"))
    rows = sorted(tuple(r) for r in plan_retirement(eligible, catalog, 0, 20_000).collect())
    assert rows[0][0] == 1 and rows[-1][1] == 20_000
    assert all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:]))
    assert plan_retirement(eligible.where("sequence > 5"), catalog, 0, 20_000).count() == 0


def plain_fingerprint(rows):
    sums = [0] * 8
    for row in rows:
        text = "".join("N" if v is None else f"V{len(str(v).encode())}:{v}" for v in row)
        digest = hashlib.sha256(text.encode()).hexdigest()
        sums = [s + int(digest[8 * i : 8 * i + 8], 16) for i, s in enumerate(sums)]
    return ":".join(map(str, [len(rows), *sums]))


def test_fingerprints_add_up(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"é{i}") for i in range(50)] + [(1, "a"), (1, "a")]
    df = spark.createDataFrame(rows, "k bigint, v string")
    text = lambda f: f.select(as_text()).first()[0]
    assert text(fingerprint(df, ["k", "v"])) == plain_fingerprint(rows)
    parts = fingerprint(df.repartition(5), ["k", "v"], by=("k",))
    assert text(combined(parts)) == plain_fingerprint(rows)
    left = [r for r in rows if r[0] != 3]
    gone = fingerprint(df.where("k = 3"), ["k", "v"])
    assert text(without(fingerprint(df, ["k", "v"]), gone)) == plain_fingerprint(left)
    assert text(fingerprint(df.limit(0), ["k", "v"])) == plain_fingerprint([])
    # One copy more of a row that is there twice is seen, as is a value that moves to its neighbour.
    assert plain_fingerprint(rows) != plain_fingerprint([*rows, (1, "a")])


def test_part_digests_see_changes(spark):
    lines = [(1 + i // 1500, i, f"line {i}") for i in range(3000)]
    schema = "part bigint, sequence bigint, line string"

    def digests(rows):
        df = spark.createDataFrame(rows, schema).repartition(4)
        return {r.part: r.plain_sha256 for r in part_digests(df).collect()}

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    plain = {}
    for part in (1, 2):
        blocks: dict = {}
        for _, n, line in (x for x in lines if x[0] == part):
            blocks.setdefault(n // 1000, []).append(sha(line))
        plain[part] = sha("".join(sha("".join(d)) for _, d in sorted(blocks.items())))
    assert digests(lines) == plain
    assert digests([*lines[:-1], (2, 2999, "line x")])[2] != plain[2]
    assert digests(lines[1:])[1] != plain[1] and digests([*lines, lines[5]])[1] != plain[1]


def test_numbers_have_their_shortest_text(spark):
    known = {"1e2": "100", "1.0": "1", "-0.0": "-0", "0.0000001": "1e-7", "1e40": "1e+40", "1e21": "1e+21",
             "12345678901234567890": "12345678901234567000", "9007199254740993": "9007199254740992",
             "5e-324": "5e-324", "1e400": "1e400", "-3.50": "-3.5", "0.000001": "0.000001"}
    assert {k: shortest_number(k) for k in known} == known
    texts = ['{"a":"1e2, 2.0","b\\"":[1e2,-2.0],"c":3}', '{"n":7}', None, '"1.0"', "[0.10]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(shortest_numbers(F.col("t"))).collect()]
    assert found == ['{"a":"1e2, 2.0","b\\"":[100,-2],"c":3}', '{"n":7}', None, '"1.0"', "[0.1]"]
    assert json.loads(found[0])["c"] == 3
