"""Model files, matrices by key and by site, trials of lengths, and reading and writing of any format."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideline.operators import algebra, encode, rates, trials
from tideline.sources import alignments as al
from tideline.sources import models

NEXUS = """#nexus
begin models;
model Even=
1
1 1 [ a comment; with a
break ]
1 1 1
0.2 0.2 0.2 0.2;
model whole =
-3 1 1 1
1 -3 1 1
2 1 -4 1
1 1 1 -3
0.1 0.2 0.3 0.4;
end;
"""


def _file(tmp_path, text):
    path = tmp_path / "models.nex"
    path.write_text(text)
    return str(path)


def test_models_of_both_kinds(spark, tmp_path):
    exchange, freqs = models.read_models(spark, _file(tmp_path, NEXUS), "ACGT")
    got = {(r.model, r.from_state, r.to_state): r.s for r in exchange.collect()}
    assert len(got) == 6 + 16 and got["WHOLE", "G", "A"] == 2 and ("EVEN", "A", "C") not in got
    assert {(r.model, r.state): round(r.freq, 9) for r in freqs.collect()}["EVEN", "T"] == 0.25
    even = rates.exchange_matrix(exchange.where("symmetric"), freqs, ["model"]).collect()
    assert {(r.from_state, r.to_state): round(r.q, 9) for r in even} == {(r.from_state, r.to_state): round(r.q, 9) for r in rates.equal_rates(spark).collect()}


@pytest.mark.parametrize("body", ["1 1 1 1 1 1 0.2 0.2 0.2", "1 1 1 -1 1 1 0.2 0.2 0.2 0.2", "1 1 1 x 1 1 0.2 0.2 0.2 0.2", "-3 1 1 1 1 -3 1 1 2 1 -3 1 1 1 1 -3 0.1 0.2 0.3 0.4", "1 1 1 1 1 1 0.2 -0.2 0.2 0.2"])
def test_wrong_models(spark, tmp_path, body):
    with pytest.raises(al.FormatError, match="BAD"):
        models.read_models(spark, _file(tmp_path, f"model bad=\n{body};"), "ACGT")


def test_exchange_matrix_against_loops(spark):
    pi = {"A": 0.1, "C": 0.2, "G": 0.3, "T": 0.4}
    s = {("A", "C"): 1.0, ("A", "G"): 4.0, ("A", "T"): 0.5, ("C", "G"): 1.5, ("C", "T"): 3.0, ("G", "T"): 1.0}
    raw = {(a, b): (s.get((a, b)) or s[b, a]) * pi[b] for a in pi for b in pi if a != b}
    mean = sum(pi[a] * q for (a, _), q in raw.items())
    got = rates.exchange_matrix(spark.createDataFrame([(*k, v) for k, v in s.items()], "from_state string, to_state string, s double"), spark.createDataFrame(list(pi.items()), "state string, freq double"))
    got = {(r.from_state, r.to_state): r.q for r in got.collect()}
    assert len(got) == 16
    for k, q in raw.items():
        assert got[k] == pytest.approx(q / mean)
    assert sum(got["A", x] for x in pi) == pytest.approx(0)


def test_site_matrices(spark):
    shared = rates.equal_rates(spark, "AC")
    sites = spark.createDataFrame([(0,), (1,), (2,)], "pos int")
    own = spark.createDataFrame([(1, a, b, 9.0 if a != b else -9.0) for a in "AC" for b in "AC"], "pos int, from_state string, to_state string, q double")
    got = rates.site_matrices(sites, shared, own, spark.createDataFrame([(2, 0.5)], "pos int, rate double"))
    assert {r.pos: r.q for r in got.collect()} == {0: [[-1.0, 1.0], [1.0, -1.0]], 1: [[-9.0, 9.0], [9.0, -9.0]], 2: [[-0.5, 0.5], [0.5, -0.5]]}


def test_reports(spark):
    q = rates.equal_rates(spark, "AC")
    assert [r.line for r in models.matrix_lines(q, "AC").orderBy("seq").collect()] == ["\tA\tC", "A\t-1.0\t1.0", "C\t1.0\t-1.0"]
    sites = q.crossJoin(spark.createDataFrame([(0,), (1,)], "pos int"))
    lines = [r.line for r in models.matrix_lines(sites, "AC", "pos").orderBy("seq").collect()]
    assert lines[0] == "Position: 0\n\tA\tC" and lines[3] == "Position: 1\n\tA\tC" and len(lines) == 6
    freqs = spark.createDataFrame([("C", 0.75), ("A", 0.25)], "state string, freq double")
    assert [r.line for r in models.frequency_lines(freqs, "AC").orderBy("seq").collect()] == ["A\tC", "0.25\t0.75"]


def test_trials_stop_at_the_first_loss(spark):
    costs = {"up": [1.0, 2.0, 3.0], "peak": [1.0, 2.0, 1.5, 9.0], "flat": [1.0, 1.0], "none": [1.0, None, 5.0], "one": [1.0]}
    rows = [(key, k, 0.5**k, c) for key, row in costs.items() for k, c in enumerate(row)]
    best = trials.best_trial(spark.createDataFrame(rows, "key string, k int, length double, cost double"), ["key"])
    assert {r.key: r.k for r in best.collect()} == {"up": 2, "peak": 1, "flat": 0, "none": 0, "one": 0}


@pytest.mark.parametrize("kind", ["fasta", "PHYLIP", "delta"])
def test_one_entry_reads_what_it_wrote(spark, tmp_path, kind):
    source = tmp_path / "in.fa"
    source.write_text(">a\nACGTNNA\n>b\nACGTACA\n>c\nTCGT-CA\n")
    reference, rows, mut = al.read_alignment(spark, str(source))
    path = str(tmp_path / "out")
    al.write_alignment(path, reference, rows, mut, kind)
    again = al.read_alignment(spark, path, reference=None if kind == "delta" else reference)
    facts = lambda x: (x[0], sorted(map(tuple, x[1].collect())), sorted(map(tuple, x[2].collect())))
    assert facts(again) == facts((reference, rows, mut))
    assert reference == "ACGTAAA"  # the N of the first row wins its site and becomes A
    with pytest.raises(Exception, match="already exists"):
        al.write_alignment(path, reference, rows, mut, kind)


def test_formats_and_references_that_do_not_fit(spark, tmp_path):
    source = tmp_path / "in.fa"
    source.write_text(">a\nACGT\n>b\nACGT\n>c\nACGA\n")
    assert [al.format_named(x) for x in ("FASTA", "Auto", "x")] == ["fasta", "auto", "unknown"]
    for wrong in ({"file_format": "x"}, {"reference": "ACG"}, {"least": 4}):
        with pytest.raises(al.FormatError):
            al.read_alignment(spark, str(source), **wrong)
    with pytest.raises(al.FormatError):
        al.read_rows(spark, str(source), "delta")
    with pytest.raises(al.FormatError):
        al.write_alignment(str(tmp_path / "o"), "A", spark.range(0), spark.range(0), "auto")
    assert encode.consensus(al.cells(al.read_rows(spark, str(source), "Fasta"))).count() == 4


def test_small_changes_of_a_length_are_left_alone(spark):
    rows = [("near", 0.1, 0.1005, 0.1), ("far", 0.1, 0.102, 0.102), ("gone", 0.1, None, None), ("new", 0.0, 0.1, 0.1), ("none", 0.0, None, 0.0)]
    got = spark.createDataFrame(rows, "key string, old double, new double, want double").withColumn("x", algebra.changed_length(F.col("old"), F.col("new")))
    assert {r.key: r.x for r in got.collect()} == {key: want for key, _, _, want in rows}


def test_lengths_to_try(spark):
    lengths = lambda *a: [x.length for x in spark.range(1).select(trials.trial_lengths(F.lit(a[0]), *a[1:]).alias("x")).first().x]
    assert lengths(1.0, 0.5, 0.2, 1.0) == [1.0, 0.5, 0.25]
    assert lengths(1.0, 2.0, 0.2, 4.0) == [1.0, 2.0, 4.0]
    assert lengths(0.1, 0.5, 0.2, 1.0) == [0.1]
