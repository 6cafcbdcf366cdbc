"""Results that do not depend on how files are split, and plans that stay bounded."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate, language_id, mixture, ngram_join
from tideline.llm.common import scratch


def test_mixture_does_not_depend_on_splits(spark):
    """More documents of one source than a bucket holds, with equal rows and ids, read in two ways."""
    rng = random.Random(4)
    rows = [(i % 9_500, " ".join(["w"] * rng.randint(0, 30)) + str(i % 9_500 % 50), "one") for i in range(10_000)] + [(1, "same text", "one")] * 300 + [(None, None, None)] * 5
    path = scratch(spark, "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12).write.parquet(path)
    one = spark.read.parquet(path)
    other = one.repartition(7).sortWithinPartitions(F.hash("text"))
    report = lambda df: sorted(map(tuple, mixture.mixture_report(df).collect()), key=str)
    first = report(one)
    assert first == report(other) and len(first) == len(rows)
    taken, target = sum(r[4] for r in first), {r[3] for r in first if r[2]}
    assert abs(taken - target.pop()) <= mixture.BLOCK_WORDS and not target
    assert all(r[4] <= 2 * r[1] for r in first)


def test_copies_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SLOT_RUN", 4)
    rows = spark.createDataFrame([("a", 7, 10, 3), ("b", 100, 10, 5), ("c", 150, 0, 2), ("d", 200, 1, 13)], "h string, begin long, size long, copies long")
    got = sorted(map(tuple, mixture.copied(rows).collect()))
    assert got == sorted((h, b + k * n, n) for h, b, n, c in rows.collect() for k in range(c))


@pytest.mark.parametrize("size", [1, 3, 11])
def test_blocks_of_patterns_are_separate_jobs(spark, size):
    """Each block of patterns has a pass of its own: no stage has more than one Python step, and results are those of one block."""
    rng = random.Random(size)
    word = lambda: f"w{rng.randint(0, 40)}"
    items = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(None, "w1 w2")], "item_id long, text string")
    texts = [r.text for r in items.collect()]
    docs = spark.createDataFrame([(i, " ".join([word(), texts[i % 41], word(), word(), texts[(i * 7) % 41]])) for i in range(120)] + [(1, None), (1, "")], "doc_id long, text string").repartition(3)
    whole = decontaminate.find_contamination(docs, items)
    parts = decontaminate.find_contamination(docs, items, block_bytes=size * decontaminate.WINDOW_BYTES * 12)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(parts) == rows(whole)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) <= 2


def test_a_language_with_few_lettered_texts_is_learnt(spark):
    rows = [(i, "bonjour le monde et la mer", "fr") for i in range(40)] + [(100 + i, "123 456 --", "xx") for i in range(400)] + [(600 + i, "zzzq qqzz zqzq", "xx") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.train_language_id(docs, bound=64)
    assert set(network.languages) == {"fr", "xx"}


def test_texts_travel_once_within_their_rows():
    texts = ["a b c d e f", "a  b c d e f", None, "x"]
    row = pa.StructArray.from_arrays([pa.array(texts), pa.array([4, 3, 2, 1])], names=["body", "doc_id"])
    out = pa.Table.from_batches(ngram_join._with_class(iter([pa.RecordBatch.from_arrays([row, pa.array([4, 3, 2, 1])], names=["row", "doc_id"])]), 5, "body")).to_pydict()
    assert [r["body"] for r in out["row"]] == texts and out["doc_id"] == [4, 3, 2, 1]
    # white space is no part of words
    assert out["node"][0] == out["node"][1] and out["body"][0] == out["body"][1] and len(set(out["node"])) == 3
