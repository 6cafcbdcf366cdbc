"""Each stage of the corpus pipeline against a brute-force version, and the whole run, with nulls, empty texts, repeated rows and ids."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import quality
from tideline.llm.mixture import BLOCK_WORDS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: documents with columns that have the names of the operators' own
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, row string, score string, hit_words string, node string, spans string"
ITEM = "who was the first person to walk along the great river at night"


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def documents() -> list[tuple]:
    rng = random.Random(11)
    rows: list[tuple] = []

    def add(i: int | None, text: str | None) -> None:
        rows.append((i, text, "en", rng.choice(["a", "b", None]), None if text is None else len(text), "row", "score", "hits", "node", "spans"))

    for i in range(120):
        good = i % 4
        w = [rng.choice(["walk", "tree", "house", "river", "cloud"]) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 60))]
        add(i, " ".join(w) + "." if good else "".join(x.upper() + rng.choice("!#$%") for x in w))
        if i % 10 == 1:
            add(1000 + i, " ".join(w) + ".")  # the same words
            add(2000 + i, " ".join([*w[:-1], "changed"]) + ".")
    long = [f"word{k} of the text" for k in range(60)]
    add(5, " ".join(long))  # an id with several texts
    add(5, " ".join(reversed(long)))
    add(5, " ".join(reversed(long)))
    add(3000, " ".join(long[:20]) + " " + ITEM + " " + " ".join(long[40:]))
    add(3001, "Short item here, and more words that stand for themselves")
    add(3002, "Reach jo.doe@example.org or +1 (555) 123-4567 from 10.1.2.3 with 4111 1111 1111 1111 é😀 now, please, before the tree falls")
    for text in (None, "", " \n "):
        add(4000, text)
        add(None, text)
    add(None, "a text without an id that says little but is there and has words")
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)] + [(7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (None, "?!")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def slow_statistics(text: str) -> list[float]:
    data = (text or "").encode()
    n = max(len(data), 1)
    kinds = [quality._CLASSES[quality._CLASS_OF[b]] for b in data]
    count = {c: kinds.count(c) for c in quality._CLASSES}
    w = [x.encode() for x in WORD.findall(text or "")]
    some = max(len(w), 1)
    length = [len(x) for x in w]
    mean = sum(length) / some
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else [])
    lines = [x for x in data.split(b"\n") if x]
    letters = count["lower"] + count["upper"] + count["high"]
    return [
        *[count[c] / n for c in quality._CLASSES],
        math.log1p(len(data)), math.log1p(len(w)), mean, math.sqrt(max(sum(x * x for x in length) / some - mean**2, 0)), math.log1p(max(length, default=0)),
        sum(x <= 2 for x in length) / some, len(set(w)) / some, len(set(tri)) / max(len(tri), 1), math.log1p(len(lines)), len(set(lines)) / max(len(lines), 1),
        len(w) / max(len(lines), 1), count["upper"] / max(letters, 1), len(w) / max(count["stop"], 1), sum(a == b for a, b in zip(w, w[1:], strict=False)) / some,
    ]


def slow_score(forest, x: list[float]) -> float:
    total = forest.start
    for t in range(len(forest.feature)):
        at = 0
        while at < 2**quality.DEPTH - 1:
            at = 2 * at + 1 + int(x[forest.feature[t, at]] > forest.threshold[t, at])
        total += forest.leaf[t, at - (2**quality.DEPTH - 1)]
    return 1 / (1 + math.exp(-total))


def test_quality_stage(spark, docs, sf_dir):
    forest = quality.train_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in docs.limit(20).collect():
        from tideline.llm.textkernel import chunks
        import pyarrow as pa

        [chunk] = chunks(pa.array([r.text]))
        assert np.allclose(quality.statistics(chunk)[0], slow_statistics(r.text))
    want = [tuple(r) for r in docs.collect() if slow_score(forest, slow_statistics(r.text)) >= 0.5]
    got = plain(corpus_pipeline.quality(spark, docs, sf_dir))
    assert got == sorted(want, key=str) and 60 < len(got) < docs.count()


def slow_keep(rows: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    """One text of each component stays, that of the smallest id; rows of one id and set count as one; others all stay."""
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    whole = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    group = {i: i for i in whole}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in whole:
        for j in whole:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    kept = [r for i, r in enumerate(rows) if i not in group]
    for g in {find(i) for i in whole}:
        own = [i for i in whole if find(i) == g]
        kept.append(rows[min(own, key=lambda i: rows[i][0])])
    return kept


def test_near_duplicates_stage(spark, docs, sf_dir):
    rows = [tuple(r) for r in docs.collect()]
    got = plain(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    want = sorted(slow_keep(rows), key=str)
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want] and set(got) <= set(rows)
    assert len(got) < len(rows) - 20


def test_decontaminate_stage(spark, docs, sf_dir):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for text in (ITEM, "short item"):
        w = word.findall(lower(text))
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)}

    def hit(text):
        w = word.findall(lower(text))
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    rows = [tuple(r) for r in docs.collect()]
    got = plain(corpus_pipeline.decontaminate(spark, docs, sf_dir))
    assert got == sorted((r for r in rows if not hit(r[1])), key=str) and len(got) == len(rows) - 2


def test_personal_data_stage(spark, docs, sf_dir):
    from test_llm_operators import base_spans

    rows = [tuple(r) for r in docs.collect()]
    want = []
    for r in rows:
        text, spans = r[1], sorted((a, b, k) for k, a, b in base_spans(r[1] or ""))
        for a, b, k in reversed(spans):
            text = text[:a] + f"<{k.upper()}>" + text[b:]
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    assert plain(corpus_pipeline.personal_data(spark, docs, sf_dir)) == sorted(want, key=str)
    assert any("<EMAIL> or <PHONE> from <IP> with <CARD>" in (r[1] or "") for r in want)


def test_mixture_stage(spark, docs, sf_dir):
    rows = [tuple(r) for r in docs.collect()]
    got = corpus_pipeline.mixture(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((r[0], len(WORD.findall(r[1] or ""))) for r in rows), key=str)
    sources: dict = {}
    for r in rows:
        sources[r[3]] = sources.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    by_size: dict = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size in sources.values()
        by_size.setdefault(r.source_size, [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= BLOCK_WORDS for t, target in by_size.values())


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    taken = corpus_pipeline.run(spark, sf_dir)
    stage = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, sf_dir)
    assert plain(taken.select("doc_id", "size")) == plain(stage.select("doc_id", "size")) and taken.count() > 50
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
