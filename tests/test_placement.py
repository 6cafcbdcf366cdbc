"""Placement on profiles, in one go and as a stream."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import placement
from tideline.operators.placement import best_placement, best_places, near_placements, placement_costs
from tideline.streaming import incremental

STEP = 0.1
PROFILES = {1: "ACGT", 2: "ACGG", 3: "TTTT", 4: "ACGT"}
ROWS = [(10, "ACGT"), (11, "ACNG"), (12, "TTTA"), (13, "----")]


def _frames(spark):
    profiles = spark.createDataFrame([(k, i, c) for k, v in PROFILES.items() for i, c in enumerate(v)], "label int, pos int, ref string")
    matrix = spark.createDataFrame([(a, b, -0.9 if a == b else 0.3) for a in "ACGT" for b in "ACGT"], "from_state string, to_state string, q double")
    return profiles, matrix


def _sites(rows):
    return rows.select("seq", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")


def _cost(text: str, host: str) -> float:
    return sum(-0.9 * STEP if a == b else math.log(0.3 * STEP) for a, b in zip(text, host, strict=True) if a in "ACGT")


def test_costs_and_ties(spark):
    profiles, matrix = _frames(spark)
    costs = placement_costs(_sites(spark.createDataFrame(ROWS, "seq long, text string")), profiles, matrix, STEP)
    got = {(r.seq, r.label): r.lh for r in costs.collect()}
    assert got.keys() == {(s, k) for s, t in ROWS if t != "----" for k in PROFILES}  # a row without a known site has no place
    assert all(abs(lh - _cost(dict(ROWS)[s], PROFILES[k])) < 1e-9 for (s, k), lh in got.items())
    assert {r.seq: r.label for r in best_placement(costs).collect()} == {10: 1, 11: 2, 12: 3}


@pytest.mark.parametrize("block", [2, 4096])
def test_sparse_costs_are_whole_costs(spark, monkeypatch, block):
    """Profiles and sequences that are mostly equal, over one array of profiles or several; near and best places are those of all costs."""
    monkeypatch.setattr(placement, "BLOCK", block)
    rng = random.Random(6)
    base = [rng.choice("ACGT") for _ in range(40)]
    changed = lambda letters, share: "".join(rng.choice(letters) if rng.random() < share else c for c in base)
    hosts = {k: changed("ACGT", 0.1) for k in range(9)} | {20: "".join(base), 21: "".join(base)}
    texts = {k: changed("ACGTNR-", 0.2) for k in range(30)} | {50: "N" * 40, 51: "".join(base)}
    profiles = spark.createDataFrame([(k, i, c) for k, v in hosts.items() for i, c in enumerate(v)], "label int, pos int, ref string")
    q = {(a, b): -0.9 if a == b else rng.choice((0.2, 0.3, 0.4)) for a in "ACGT" for b in "ACGT"}
    matrix = spark.createDataFrame([(a, b, x) for (a, b), x in q.items()], "from_state string, to_state string, q double")
    sites = _sites(spark.createDataFrame(list(texts.items()), "seq long, text string"))
    want = {(s, k): sum(q[a, b] * STEP if a == b else math.log(q[a, b] * STEP) for a, b in zip(host, text, strict=True) if b in "ACGT") for s, text in texts.items() if s != 50 for k, host in hosts.items()}
    got = {(r.seq, r.label): r.lh for r in placement_costs(sites, profiles, matrix, STEP).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    top = {s: max(round(want[s, k], 6) for k in hosts) for s in texts if s != 50}
    near = {(r.seq, r.label) for r in near_placements(sites, profiles, matrix, STEP, 3.0).collect()}
    assert near == {(s, k) for s, k in want if round(want[s, k], 6) >= top[s] - 3.0} and len(near) < len(want)
    best = {r.seq: (r.label, r.lh) for r in best_places(sites, profiles, matrix, STEP).collect()}
    assert best == {s: (min(k for k in hosts if round(want[s, k], 6) == top[s]), pytest.approx(top[s])) for s in top}


def test_stream_places_each_sequence_once(spark, tmp_path):
    profiles, matrix = _frames(spark)
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def run():
        stream = spark.readStream.schema("seq long, text string").parquet(source)
        incremental.place_stream(stream, _sites, profiles, matrix, store, STEP).awaitTermination()
        return sorted((r.seq, r.label, r.batch) for r in incremental.placements(spark, store).collect())

    spark.createDataFrame(ROWS[:2], "seq long, text string").write.parquet(source)
    assert run() == [(10, 1, 0), (11, 2, 0)]
    # a sequence that comes again, with another text, stays where it is
    spark.createDataFrame([(10, "TTTT"), ROWS[2]], "seq long, text string").write.mode("append").parquet(source)
    assert run() == [(10, 1, 0), (11, 2, 0), (12, 3, 1)]
    assert run() == [(10, 1, 0), (11, 2, 0), (12, 3, 1)]
