"""Rows taken in by others, against brute force, and how the work grows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import absorption, segments, trees

BITS = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "M": 3, "N": 15, "-": 15}


def frames(spark, texts, ref):
    """Rows and differences of {(aln, seq): text}."""
    rows, diffs = [], []
    for (aln, seq), text in texts.items():
        rows.append((aln, seq))
        i = 0
        while i < len(text):
            j = i
            while text[i] in "N-" and j + 1 < len(text) and text[j + 1] == text[i]:
                j += 1
            if text[i] != ref[i]:
                diffs.append((aln, seq, i, j, BITS[text[i]], BITS[ref[i]]))
            i = j + 1
    return spark.createDataFrame(rows, "aln int, seq long"), spark.createDataFrame(diffs, "aln int, seq long, start int, stop int, bits int, ref_bits int")


def plain(texts):
    found = {}
    for (aln, b), tb in texts.items():
        hosts = [a for (other, a), ta in texts.items() if other == aln and a < b and all(BITS[x] & BITS[y] == BITS[x] for x, y in zip(ta, tb, strict=True))]
        if hosts:
            found[aln, b] = min(hosts)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_absorbed_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(14))
    texts = {}
    for aln in range(3):
        family = ["".join(rng.choice("ACGT") if rng.random() < 0.15 else c for c in ref) for _ in range(3)] + [ref]
        for seq in range(60):
            base = rng.choice(family)
            text = [rng.choice("RYMNACGT") if rng.random() < 0.1 else c for c in base]
            a, b = rng.randint(0, 4), rng.randint(10, 14)
            text[:a] = rng.choice("N-") * a
            text[b:] = "N" * (14 - b)
            texts[aln, seq] = "".join(text)
    texts[3, 7] = texts[3, 9] = ref
    texts[3, 8] = "N" * 14
    texts[4, 1] = "N" * 14
    got = {(r.aln, r.seq): r.host for r in absorption.absorbed(*frames(spark, texts, ref)).collect()}
    want = plain(texts)
    assert got == want and len(want) > 60


def near_equal(n, sites, seed=1):
    """{seq: {site: bits}} of rows that share most of their sites with a reference of A: a few common changes, two of their own, unknown ends, and one
    in ten a copy of an earlier row with more unknown."""
    rng = random.Random(seed)
    rows: dict[int, dict[int, int]] = {}
    for seq in range(n):
        if seq % 10 == 9:
            rows[seq] = rows[rng.randrange(seq)] | dict.fromkeys(rng.sample(range(sites), 3), 15)
        else:
            own = {k: rng.choice((2, 4, 8)) for k in rng.sample(range(sites), 2)}
            rows[seq] = dict.fromkeys([50, 100, 150][: rng.randint(0, 3)], 4) | own | dict.fromkeys(range(rng.randint(0, 5)), 15)
    return rows


def as_frames(spark, rows):
    diffs = [(0, seq, k, k, bits, 1) for seq, own in rows.items() for k, bits in own.items()]
    return spark.createDataFrame([(0, seq) for seq in rows], "aln int, seq long"), spark.createDataFrame(diffs, "aln int, seq long, start int, stop int, bits int, ref_bits int")


def test_work_grows_with_rows(spark):
    counted = []
    for n in (6_000, 12_000):
        distinct = absorption.classes(absorption.runs_of_rows(*as_frames(spark, near_equal(n, 8_000)))).cache()
        counted.append(absorption.candidates(distinct, absorption.hosts(distinct)).count())
        distinct.unpersist()
    # a third of all pairs would be 12 and 48 million
    assert counted[0] < 6_000 and counted[1] < 12_000 and counted[1] < 3 * counted[0]


def test_each_copy_finds_its_row(spark):
    rows = near_equal(600, 400)
    got = {r.seq: r.host for r in absorption.absorbed(*as_frames(spark, rows)).collect()}
    takes_in = lambda a, b: all(a.get(k, 1) & b.get(k, 1) == a.get(k, 1) for k in a.keys() | b.keys())
    want = {b: min(hosts) for b in rows if (hosts := [a for a in range(b) if takes_in(rows[a], rows[b])])}
    assert got == want and len(got) >= 60


def test_informativeness_modes(spark):
    rows = [(0, 1, 1), (0, 4, 4), (1, 1, 15), (1, 4, 4), (2, 15, 1), (3, 1, 2), (4, 1, 3), (4, 15, 4), (5, 5, 7)]
    df = spark.createDataFrame(rows, "seq int, a int, b int")
    code = lambda **k: {r.seq: r.code for r in segments.informativeness(df, ["seq"], **k).collect()}
    assert code() == {0: 1, 1: 1, 2: -1, 3: 0, 4: 0, 5: 1}
    assert code(identical=True) == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_no_rows(spark):
    rows, diffs = frames(spark, {(0, 1): "AC"}, "AC")[0], spark.createDataFrame([], "aln int, seq long, start int, stop int, bits int, ref_bits int")
    assert absorption.absorbed(rows.limit(0), diffs).count() == 0
    assert absorption.absorbed(rows, diffs).where(F.lit(True)).count() == 0


def test_growing_tables_are_not_broadcast(spark):
    rows, diffs = map(trees.written, as_frames(spark, near_equal(60, 200)))
    planned = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    # the rows without a difference, one for each alignment, go to all tasks and nothing else does
    assert planned(absorption.absorbed(rows, diffs)).count("BroadcastHashJoin") == 1
    packed = absorption.runs_of_rows(rows, diffs)
    assert "Broadcast" not in planned(packed)
    distinct = absorption.classes(packed)
    assert "Broadcast" not in planned(absorption.candidates(distinct, absorption.hosts(distinct).select("aln", "pos", "bits", "host", "host_hard", "host_mask").localCheckpoint()))
