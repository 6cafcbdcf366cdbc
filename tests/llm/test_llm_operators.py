"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import chunking, cross_entropy, decontaminate, language_id, mixture, nearest, ngram_join, pii, prefix_tree, quality, sketch, textkernel, token_counts

DOCS = "doc_id long, text string, lang string, source string, score string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank, one word, no ASCII, a very long text and a very long word."""
    texts = [None, "", " \n\t ", "One", "é😀 ß", "lorem ipsum dolor " * 20_000, "x" * 700_000]
    return [(1000 + i, t, None, None, "clash", "clash") for i, t in enumerate(texts)]


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = []
    for b in range(n):
        base = [rng.choice(["alpha", "Beta", "gamma,", "delta", "the", "of", "éclair"]) + str(rng.randint(0, 400)) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 9999))
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None]), "clash", "clash"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(1) + odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["ab cd ab", None, "", "x" * 300 + " ab", "cd"]
    whole = [textkernel.words(c, textkernel.SPACE_SEPARATORS) for c in textkernel.chunks(pa.array(texts))]
    monkeypatch.setattr(textkernel, "PIECE", 7)
    textkernel._cache.clear()
    parts = [textkernel.words(c, textkernel.SPACE_SEPARATORS) for c in textkernel.chunks(pa.array(texts))]
    textkernel._cache.clear()
    for a, b in zip(whole, parts, strict=True):
        assert a.hash.tolist() == b.hash.tolist() and a.row.tolist() == b.row.tolist() == [0, 0, 0, 3, 3, 4]
    assert whole[0].hash[0] == whole[0].hash[2] == whole[0].hash[4] != whole[0].hash[1]


# nearest neighbours


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 24)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a class with half of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(700, None), (750, [0.0] * 24), (800, [float("nan")] * 24), (850, [None] * 24), (900, [1.0, 2.0]), (950, [1.0, 2.0]), (0, vectors[0].tolist())]
    got = collections.defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = vectors.astype(float)
    norm = np.linalg.norm(v, axis=1)
    for q in range(0, 600, 50):
        s = v @ v[q] / (norm * norm[q])
        s[q] = -9
        same = np.abs(s - 1) < 1e-12
        s[same] = 1
        want = np.lexsort((np.arange(600), -s))[:5]
        assert [i for i, _ in got[q]] == want.tolist()
        assert np.allclose([x for _, x in got[q]], s[want])
    assert [i for i, _ in got[900]] == [950] and set(got) == {*range(0, 600, 50), 900, 950}
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(500, 64)), rng.normal(size=(40, 64))
    centre = v[:50].mean(0) / 10
    bits, scalars = nearest.encode(v, centre)
    guess, error = nearest.estimate(bits, scalars, q, centre)
    exact = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    assert (np.abs(guess - exact) <= error).mean() > 0.99 and abs((guess - exact).mean()) < 0.01


# language model scores


def pieces_of(text: str | None) -> list[str]:
    out = []
    for w in WORD.findall(lower(text)):
        out += [("" if k else "^") + w[k : k + cross_entropy.WIDTH] for k in range(0, len(w), cross_entropy.WIDTH)]
    return out


def slow_scores(rows: list[tuple], target: set[int]) -> list[tuple]:
    """(id, tokens, target loss, background loss) of each row, each occurrence being left out of the counts it is scored by."""
    texts = [(r[0], pieces_of(r[1])) for r in rows]
    sides = [[collections.Counter(), collections.Counter(), 0] for _ in range(2)]
    grams = []
    for i, p in texts:
        steps = list(zip(["$", *p], [*p, "$"], strict=True)) if p else []
        grams.append(steps)
        side = sides[i not in target]
        side[0].update(w for _, w in steps)
        side[1].update(steps)
        side[2] += len(steps)
    total = sides[0][2] + sides[1][2]
    out = []
    for (i, _), steps in zip(texts, grams, strict=True):
        loss = []
        for k, (uni, bi, n) in enumerate(sides):
            off = (i in target) == (k == 0)
            scale = float(sides[1][2] > 0) if k == 0 else (sides[0][2] / n if n else 0.0)
            value = 0.0
            for v, w in steps:
                q = (sides[0][0][w] + sides[1][0][w]) / total
                p = ((uni[w] - off) * scale + 4 * q) / ((n - off) * scale + 4)
                p = ((bi[v, w] - off) * scale + 4 * p) / ((uni[v] - off) * scale + 4)
                value -= math.log(p)
            loss.append(value / max(len(steps), 1))
        out.append((i, len(steps), *loss))
    return out


@pytest.mark.parametrize("chunk_bytes", [16 << 20, 3000])
def test_cross_entropy_matches_brute_force(spark, docs, rows, monkeypatch, chunk_bytes):
    monkeypatch.setattr(cross_entropy, "CHUNK_BYTES", chunk_bytes)
    wanted = {*range(0, 200, 3), 1005}
    target = spark.createDataFrame([(i,) for i in wanted] + [(99999,), (3,), (None,)], "doc_id long")
    twice = docs.unionByName(docs.where("doc_id in (3, 4)"))
    twice = twice.unionByName(spark.createDataFrame([(None, "no id at all", "", "", "", ""), (77777, "x\u2003y ßßßßß", "", "", "", "")], DOCS))
    every = rows + [r for r in rows if r[0] in (3, 4)] + [(None, "no id at all"), (77777, "x\u2003y ßßßßß")]
    got = sorted(tuple(r) for r in cross_entropy.cross_entropy_difference(twice, target).collect() if r.doc_id is not None)
    want = sorted(x for x in slow_scores(every, wanted) if x[0] is not None)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:], abs=1e-9) and g[4] == pytest.approx(w[2] - w[3], abs=1e-9)


def test_cross_entropy_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in cross_entropy.cross_entropy_difference(docs, none).collect()} == {0.0}
    assert {r.score for r in cross_entropy.cross_entropy_difference(docs, docs.select("doc_id")).collect()} == {0.0}
    assert cross_entropy.cross_entropy_difference(empty, none).count() == 0


def test_cross_entropy_tells_the_target(spark):
    """Held-out texts of the target's kind score lower than others."""
    rng = random.Random(8)
    kinds = [[f"{a}{b}" for a in "bcdfg" for b in ("al", "en", "or")], [f"{a}{b}" for a in "mnprt" for b in ("ax", "iv", "uz")]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) + rng.choice(kinds[i % 2]) for _ in range(40))) for i in range(200)]
    target = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in cross_entropy.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), target).collect()}
    assert max(got[i] for i in range(100, 200, 2)) < min(got[i] for i in range(101, 200, 2))


# mixture


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(sizes).collect()}
    cap = {"a": 200.0, "b": 2000.0, "c": 20.0, "d": 0.0, None: 100.0}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, full = {}, set()
    total = 1.5 * 1160
    while True:  # the contract's own loop: stop at the cap, share the excess
        rest = total - sum(cap[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        want = {s: cap[s] if s in full else rest * weight[s] / share for s in weight}
        above = {s for s in weight if s not in full and want[s] > cap[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixture.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(4))).collect()]
    assert sorted(got) == list(range(n))


def test_mixture(docs, rows, empty):
    got = {r.doc_id: r for r in mixture.mixture_report(docs).collect()}
    again = {r.doc_id: r for r in mixture.mixture_report(docs).collect()}
    assert got == again and len(got) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for i, text, _, source, *_ in rows:
        size = len(WORD.findall(text or ""))
        assert got[i].size == size and got[i].taken <= 2 * size
        by[source][0] += size
        by[source][1] += got[i].taken
        by[source][2] = got[i].target
    for size, taken, target in by.values():
        assert abs(taken - target) <= mixture.BLOCK_WORDS and target <= 2 * size
    assert mixture.mixture_report(empty).count() == 0


def test_taken_words_match_brute_force(spark):
    """Words are laid out and counted block by block in Python, with the slots as drawn; rows repeat, ids repeat and are null."""
    rng = random.Random(7)
    rows = [(i // 2, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", None])) for i in range(80)] + [(3, "w w w", "b")] * 3 + [(None, "w " * 40, "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    known, mix = mixture.mix_sources(docs, block_words=16)
    known = known.collect()
    base = docs.select("doc_id", "source", mixture.word_count("text").alias("size")).withColumn("row_id", F.monotonically_increasing_id())
    wanted = spark.createDataFrame(list({(r.source, r.source_size, r.target) for r in known}), "source string, source_size long, target double")
    taken = collections.Counter((r.source, r.block) for r in mixture.slots(wanted, 0, 16).collect())
    got = collections.Counter()
    blocks = collections.defaultdict(collections.Counter)
    for r in mix.collect():
        got[r.row_id] += r.words
        blocks[r.source, r.block][r.row_id] = r.words
    # every block that is taken is full of words, but for the last of its source, and every word of a source is in one block
    for source, size in {(r.source, r.source_size) for r in known}:
        n = -(-size // 16)
        assert {b for s, b in taken if s == source} <= set(range(n))
        for b in range(n):
            if taken[source, b]:
                assert sum(blocks[source, b].values()) == min(16, size - 16 * b)
    for r in known:
        parts = [(k, c[r.row_id]) for k, c in blocks.items() if c[r.row_id]]
        assert got[r.row_id] == sum(words * taken[k] for k, words in parts) <= 2 * r.size
        if all(taken[r.source, b] for b in range(-(-r.source_size // 16))):
            assert sum(words for _, words in parts) == r.size
    assert sum(got.values()) == pytest.approx(sum({r.source: r.target for r in known}.values()), abs=16 * 3)
    assert base.count() == len(known)


def test_shards_draw_their_sources(spark):
    """Source counts of shards vary as multinomial draws do, and their sums meet the targets."""
    wanted = spark.createDataFrame([("a", 60_000, 100_000.0), ("b", 40_000, 40_000.0), (None, 20_000, 20_000.0)], "source string, source_size long, target double")
    _, drawn = mixture.draws(wanted, 1, 10, 100)
    counts = np.array([[r[s] or 0 for s in ("a", "b", "null")] for r in drawn.groupBy("shard").pivot("source").count().collect()])
    assert counts.shape == (160, 3) and set(counts.sum(1)) == {100}
    share = np.array([10, 4, 2]) / 16
    assert np.allclose(counts.mean(0), 100 * share, atol=2)
    assert np.allclose(counts.std(0), np.sqrt(100 * share * (1 - share)), rtol=0.25)  # a dealt-out permutation would vary alike, but sum up exactly
    assert abs(counts.sum(0) - [10_000, 4_000, 2_000]).sum() > 0
    met = mixture.slots(wanted, 1, 10, 100)
    assert {r.source: r["count"] for r in met.groupBy("source").count().collect()} == {"a": 10_000, "b": 4_000, None: 2_000}
    assert met.select("shard", "slot").distinct().count() == 16_000
    most = met.groupBy("source", "block").count().agg(F.max("count")).first()[0]
    assert most == 2


# classifiers


def test_quality_learns_and_generalises(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.6
        w = [rng.choice(["walk", "tree", "house", "river", "cloud"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w) + "." if good else "".join(x.upper() + rng.choice("!#$%") for x in w), None, None, "c", "c"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows + odd_rows(), DOCS)
    truth = {i: q for i, q, _ in labels}
    got = quality.quality_report(docs, spark.createDataFrame(labels + [(5, None, 0), (5, truth[5], 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 607 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = quality.quality_report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_keeps_to_the_ratio_of_labels(spark):
    """Two kinds of texts, 19 and 7 of 10 good: a bound below the counts of both labels predicts as one above them."""
    rng = random.Random(12)
    rows = [(i, ("walk tree river", "CLOUD! 12 house|")[i // 3 % 2]) for i in range(2400)]
    labels = [(i, int(rng.random() < (0.95, 0.7)[i // 3 % 2])) for i, _ in rows]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    usable = collections.Counter(q for i, q in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    assert min(usable.values()) > 150
    got = []
    for bound in (10_000, 300):
        forest = quality.train_quality(docs, known, bound)
        got.append({r.doc_id: r.predicted for r in quality.score_quality(docs, forest).collect()})
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_flat_trees_are_the_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit_forest(x, y)
    slow = []
    for row in x:
        total = forest.start
        for t in range(quality.TREES):
            at = 0
            while at < 2**quality.DEPTH - 1:
                at = 2 * at + 1 + int(row[forest.feature[t, at]] > forest.threshold[t, at])
            total += forest.leaf[t, at - (2**quality.DEPTH - 1)]
        slow.append(1 / (1 + math.exp(-total)))
    assert np.allclose(forest.score(x), slow) and ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_language(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "wh", "er"], "de": ["sch", "ung", "der", "ü", "ei"], "fr": ["eau", "é", "les", "que", "oi"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(8, 300))), lang, None, "c", "c") for i, lang in enumerate(rng.choice(list(parts)) for _ in range(300))]
    docs = spark.createDataFrame(rows + odd_rows() + [(2000, "12 34 !?", None, None, "c", "c")], DOCS)
    got = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    assert len(got) == 308
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 60 and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    for i in (1000, 1001, 1002, 2000):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1004].lang_pred in parts and got[1005].lang_pred in parts
    unlabelled = language_id.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_every_label_is_sampled(spark):
    """300 languages with one or many texts each, ids that repeat: every language is in the sample, and ids count once."""
    from tideline.llm.sampling import sample_ids

    rows = [(i, f"l{i % 300}") for i in range(3000)] + [(7, "l7")] * 500 + [(9000 + i, "l0") for i in range(2000)]
    got = sample_ids(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", 600, weight="w").collect()
    by = collections.Counter(r.lang for r in got)
    assert len(by) == 300 and set(by.values()) == {2} and len({r.doc_id for r in got}) == 600
    assert {r.w for r in got} == {5.0, 1005.0}


def test_language_learns_from_an_id_once(spark):
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(ids[i % 2], "the cat sat on the mat" if i % 2 else "der Hund und das Haus", "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.language_report(docs).collect()} <= {"en", "de"}


def slow_probabilities(network, text: str) -> np.ndarray:
    """Windows, filters, pooling and softmax of the network, written out."""
    data = lower(text).encode()
    total = np.zeros(len(network.languages))
    for lo in range(0, len(data), language_id.WINDOW):
        own = list(data[lo : lo + language_id.WINDOW])
        padded = own + [0] * (language_id.WINDOW - len(own))
        e = [network.embedding[b] for b in padded]
        best = []
        for f in range(network.filters.shape[1]):
            wide = max(language_id.WIDTHS)
            responses = [sum(float(e[at + k] @ network.filters[k * language_id.DIMENSIONS : (k + 1) * language_id.DIMENSIONS, f]) for k in range(wide)) for at in range(language_id.WINDOW - wide + 1)]
            best.append(max(0.0, max(responses) + float(network.filter_bias[f])))
        z = np.array(best) @ network.weights + network.bias
        z = np.exp(z - z.max())
        total += z / z.sum() * len(own)
    return total / len(data)


def test_language_forward_pass_matches_brute_force(spark):
    network = language_id.ByteNetwork.new(["de", "en", "fr"], 3)
    texts = ["short", "é" * 200 + " mixed Text " * 40, "x" * 256, "y" * 257]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.classify_language(docs, network).collect()}
    for i, t in enumerate(texts):
        p = slow_probabilities(network, t)
        assert got[i][0] == network.languages[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-5)


# n-gram join


def components(rows: list[tuple], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append(({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (len(sets[i]), least[find(i)]) for i, r in enumerate(rows)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_groups_match_brute_force(docs, rows, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs, n, percent).collect()}
    assert got == components(rows, n, percent)


def test_pages_of_a_large_group(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAGE_SETS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs).collect()}
    assert got == components(rows, 3, 90)


def test_a_shared_passage_joins_no_candidates(spark, monkeypatch):
    """Texts with half of their words in common are not linked, and no candidate group holds them; their near copies are found."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for _ in range(40):
        w = passage + [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs, 5, 80).collect()}
    assert got == components(rows, 5, 80)
    found = []
    inner = ngram_join._candidate_groups
    monkeypatch.setattr(ngram_join, "_candidate_groups", lambda *args: found.append(inner(*args)) or found[-1])
    ngram_join.ngram_links(docs, 5, 80)
    assert {r["count"] for r in found[0].groupBy("component").count().collect()} == {2}


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_lose_no_pair(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for n in (1, 2, 5, 31, 32, 33, 200, 1000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.2, 0.5):
            drop = rng.random(n) < share
            sets.append(np.unique(np.concatenate([base[~drop], rng.integers(0, 2**63, int(drop.sum()) // 2).astype(np.uint64)])))
    sets.append(np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    packed = sketch.sketches(flat, row, size).to_pylist()
    left, right = (x.ravel() for x in np.triu_indices(len(sets), 1))
    close = set(sketch.close_pairs(size, packed, left, right, percent).tolist())
    linked, unlike = set(), set()
    for k, (i, j) in enumerate(zip(left, right, strict=True)):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both and 100 * both >= percent * (size[i] + size[j] - both):
            linked.add(k)
        elif both * 2 < size[i] and min(size[i], size[j]) > 100:
            unlike.add(k)
    assert linked and linked <= close
    assert unlike and not unlike & close


def test_ngram_groups_edges(spark, empty):
    assert ngram_join.ngram_groups(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A b  c d"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(twice).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (7, 2, 5), (8, 0, 8)], key=str)
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(twice).collect()) == ["5", "8", "None"]


def test_one_id_with_several_texts(spark):
    """A text stays or goes by itself, whatever else its id has."""
    a, b, c = "one two three four five six", "red green blue black white grey", "here is the last of all texts"
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (5, c, 4), (5, c, 4), (9, b, 5)], "doc_id long, text string, node int")
    assert sorted(ngram_join.keep_one(docs).collect()) == [(3, a, 1), (5, c, 4), (5, b, 3)]


def test_links_of_a_cluster_grow_with_its_sets(spark, monkeypatch):
    """M near copies in pages of 8 give fewer than 2 M links; a cluster whose links form a long chain is found whole."""
    monkeypatch.setattr(ngram_join, "PAGE_SETS", 8)
    rng, sets = random.Random(5), 48
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(sets):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(100 + 3 * sets)]
    rows += [(1000 + i, " ".join(chain[3 * i : 3 * i + 100])) for i in range(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, links = ngram_join.ngram_links(docs, 3, 90)
    assert links.distinct().count() < 2 * 2 * sets
    least: dict[int, int] = {}
    keys = {r.doc_id: r.key for r in ngram_join._components(found, links).collect()}
    for i, key in keys.items():
        least[key] = min(least.get(key, i), i)
    assert {i: least[k] for i, k in keys.items()} == {i: c for i, (_, c) in components(rows, 3, 90).items()}


def test_prefix_tree_against_all_pairs():
    rng = random.Random(9)
    for _ in range(60):
        base = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(3)]
        sets = [set(rng.choice(base)) ^ {rng.randint(0, 70) for _ in range(rng.randint(0, 4))} or {1} for _ in range(rng.randint(1, 20))]
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        for percent in (80, 90):
            links = prefix_tree.link_forest(arrays, percent)
            assert all(100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for i, j in links) and len(links) < max(len(sets), 1)
            group = list(range(len(sets)))
            for i, j in links:
                group = [group[j] if g == group[i] else g for g in group]
            for i in range(len(sets)):
                for j in range(i):
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        assert group[i] == group[j]


# token counts


def test_token_counts_against_the_whole_encoding(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    got = collections.defaultdict(list)
    for r in token_counts.section_tokens(docs, rule="first").orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    for i, text, *_ in rows[:40] + rows[-7:-1]:
        text = text or ""
        offsets = [a for a, _ in reference.encode(text, add_special_tokens=False).offsets]
        assert sum(r.n_tokens for r in got[i]) == len(offsets)
        assert "".join(text[r.start : r.stop] for r in got[i]) == text
        if text.isascii():
            assert [r.n_tokens for r in got[i]] == [sum(r.start <= a < r.stop for a in offsets) for r in got[i]]


def test_allocation_rules():
    ends, first = np.array([4, 10, 12]), np.array([0, 6, 9])
    assert token_counts.allocate(ends, first, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.allocate(ends, first, "last")[0].tolist() == [1, 0, 2]
    assert token_counts.allocate(ends, first, "most")[0].tolist() == [1, 1, 1]
    assert np.allclose(token_counts.allocate(ends, first, "share")[0], [1 + 2 / 6, 3 / 6, 1 + 1 / 6])


def test_most_rule_and_given_sections(spark):
    """The query's rule against spans counted byte by byte; given sections, with what lies between them as section -1; nulls and repeated rows."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("abc éß😀\n.") for _ in range(rng.randint(0, 80))) for _ in range(30)] + ["", None]
    spans = [[(a, a + 5) for a in range(0, max(len(t or "") - 8, 0), 12)] for t in texts]
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, spans, strict=True))] + [(3, texts[3], spans[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,stop:int>>")
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder, length = token_counts._encoder(f.read())

    def slow(text: str, borders: list[int]) -> list[int]:
        """Tokens by section of the byte borders: each to the first of those that hold most of its bytes."""
        out, at = [0] * (len(borders) - 1), 0
        for token in encoder.encode_ordinary(text):
            inside = [sum(lo <= b < hi for b in range(at, at + int(length[token]))) for lo, hi in zip(borders, borders[1:], strict=False)]
            out[inside.index(max(inside))] += 1
            at += int(length[token])
        return out

    for name in (None, "parts"):
        got = collections.defaultdict(list)
        for r in token_counts.section_tokens(docs, sections=name).collect():
            got[r.doc_id].append((r.start, r.stop, r.section, r.n_tokens))
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            t = t or ""
            own = sorted(set(got[i]))
            assert "".join(t[a:b] for a, b, *_ in own) == t and len(got[i]) == len(own) * (2 if i == 3 else 1)
            borders = [len(t[:a].encode()) for a, *_ in own] + [len(t.encode())]
            assert [n for *_, n in own] == slow(t, borders)
            if name and t:
                assert [(a, b) for a, b, k, _ in own if k >= 0] == spans[i]


def test_tokens_over_many_short_sections():
    """The rules against a walk over bytes, where tokens touch up to ten sections; and time that grows with their number only."""
    rng = random.Random(2)
    ends = np.cumsum([rng.randint(1, 9) for _ in range(60)])
    first = np.array(sorted({0, *rng.sample(range(1, int(ends[-1])), 120)}))
    owner = np.searchsorted(first, np.arange(ends[-1]), side="right") - 1
    want = {rule: np.zeros(len(first)) for rule in token_counts.RULES}
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        held = collections.Counter(owner[a:b].tolist())
        want["first"][owner[a]] += 1
        want["last"][owner[b - 1]] += 1
        want["most"][min(k for k in held if held[k] == max(held.values()))] += 1
        for k, n in held.items():
            want["share"][k] += n / (b - a)
    for rule in token_counts.RULES:
        np.testing.assert_allclose(token_counts.allocate(ends, first, rule)[0], want[rule])
    n = 1_000_000
    assert token_counts.allocate(np.arange(1, n + 1) * 3, np.arange(0, 3 * n, 2), "most")[0].sum() == n


def test_tokens_of_odd_sections_and_rows(spark):
    """Overlapping, empty and unbounded sections, null ids, other columns, no rows."""
    kind = "doc_id long, text string, parts array<struct<start: int, stop: int>>, n_tokens string"
    rows = [(1, "one two three", [(0, 7), (4, 9), (None, 3), (5, 5)], "x"), (None, "one", None, None), (None, None, [(0, 4)], "y")]
    docs = spark.createDataFrame(rows, kind)
    got = sorted((r.doc_id or 0, r.section, r.start, r.stop) for r in token_counts.section_tokens(docs, sections="parts").collect())
    assert [g for g in got if g[0]] == [(1, -1, 9, 13), (1, 0, 0, 7), (1, 1, 7, 9), (1, 3, 9, 9)]
    assert (0, -1, 0, 3) in got
    assert token_counts.section_tokens(docs.limit(0), sections="parts").count() == 0


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_personal_data_matches_the_patterns(spark, docs, rows):
    texts = [
        "a@b.c_d@e.f x@y a@b.c.@d.e é@x.org",
        "1.2.3.4.5.6.7.8 300.1.1.1 0000000000001.02.3.4 1.2.3",
        "4111 1111 1111 1111, +1 (555) 123-4567 +4" + "1" * 30,
        "9" * 20_000,
        "😀é jo@x.fr +49 170 1234567",
        " ".join(f"u{i}@a.b" for i in range(600)),
    ]
    more = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_report(docs.select("doc_id", "text").unionByName(more)).collect()}
    for i, text in [(r[0], r[1]) for r in rows] + [(5000 + i, t) for i, t in enumerate(texts)]:
        want = base_spans(text or "") if len(text or "") < 600_000 else []
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == s[0] for s in want) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[i].spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redact(more).collect()}
    assert clean[5004] == "😀é <EMAIL> <PHONE>" and clean[5002].startswith("<CARD>, <PHONE> +4")


def test_labelers_are_weighed():
    counts = [dict(kind="card", regex=a, gazetteer=b, context=0, shape=c, size=2, count=n) for a, b, c, n in ((1, 1, 1, 80), (-1, -1, -1, 90), (1, -1, 1, 10), (-1, 1, -1, 9))]
    model = pii.fit(counts)
    assert model.reliability["card", "regex"] > model.reliability["card", "gazetteer"] > 0.5


def test_the_model_adds_some_spans_and_rejects_others(spark):
    """Loose matches with cues are added, loose matches that look like hashes, versions or sums are not; strict ones stay in any case."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    rows, want = [], {}

    def add(before: str, value: str, after: str, kind: str | None) -> None:
        rows.append((len(rows), f"{before}{value}{after}"))
        want[len(rows) - 1] = f"{kind}:{len(before)}:{len(before) + len(value)}" if kind else ""

    for k in range(40):
        add("please write a mail to ", f"user{k} [at] site{k} [dot] org", " today", "email")
        add("my phone is ", f"({digits(3)}) {digits(3)}-{digits(4)}", " at home", "phone")
        add("reach it on host ", f"10[.]{k}[.]3[.]4", " inside", "ip")
        add("paid by visa card ", "4111.1111.1111." + digits(4), " online", "card")
        add("the serial version hash key", f"x{k} [at] y{k} [dot] zzzz", "_", None)
        add("sha key", f"999[.]{k}[.]999[.]1", "f", None)
        add("version id", f"0000/{digits(4)}/{digits(4)}/{digits(4)}", "z", None)
        add("isbn serial x", f"{'1' + digits(2)}.{digits(3)}.{digits(4)}", "x", None)
        add("", f"strict{k}@mail{k}.org", " is plain", "email")
        add("call ", f"+49 {digits(9)}", " now", "phone")
        add("server ", f"10.0.0.{k}", " is up", "ip")
        add("card ", "4111 1111 1111 1111", " was used", "card")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.span_report(docs).collect()}
    assert got == want
    assert pii.span_report(docs.limit(0)).count() == 0
    twice = pii.span_report(docs.where("doc_id = 0").union(docs.where("doc_id = 0"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    with pytest.raises(ValueError, match="base_spans"):
        pii.redact(docs.withColumn("base_spans", F.lit(1)))


# substring dedup


def test_passages(spark, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    passage, short = prose(70), prose(15)
    rows = [(i, " ".join(prose(200))) for i in range(30)]
    rows += [(100 + i, " ".join(prose(rng.randint(0, 150)) + passage + prose(rng.randint(0, 90)))) for i in range(12)]
    rows += [(200 + i, " ".join(prose(60) + short + prose(60))) for i in range(12)] + [(300, None), (301, ""), (302, "x" * 700_000), (303, "y y " * 400), (304, "z" + "y y " * 300)]
    rows += [(400, rows[0][1]), *[(401, " ".join(prose(150)))] * 2]  # what one id has twice is not shared
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chunking.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} >= {0, 400, *range(100, 112)}
    assert {r.doc_id for r in got} <= {0, 400, 303, 304, *range(100, 112)}
    text = dict(rows)
    for r in got:
        if 100 <= r.doc_id < 112:
            assert r.first_doc == 100 and text[r.doc_id][r.start : r.stop] in " ".join(passage) + " "
    assert chunking.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("size", [5, 20, 51])
def test_chunks_are_told_by_their_words(size):
    """Every window has a whole chunk, told by its own words alone, and chunks have one digest if and only if they have the same words."""
    rng = np.random.default_rng(size)
    value = np.append(rng.integers(0, 2**63, 3000), rng.integers(0, 3, 1000)).astype(np.uint64)
    value[2000:2300] = value[100:400]
    word = textkernel.mix(value)
    border, after = chunking.borders(word, size)
    start = np.arange(len(border))
    assert (border >= start).all() and (after > border).all() and (after < start + size).all()
    for s in (*range(100, 350 - size), *range(3500, 3600)):
        alone = chunking.borders(word[s : s + size], size)
        assert (border[s], after[s]) == (alone[0][0] + s, alone[1][0] + s)
    content = [word[a + 1 : b + 1].tobytes() for a, b in zip(border, after, strict=True)]
    digest = chunking.chunk_digests(word, border, after).tolist()
    assert len(set(digest)) == len(set(content)) == len(set(zip(digest, content, strict=True)))
    assert digest[100 : 400 - size] == digest[2000 : 2300 - size]


def brute_passages(rows: list[tuple], size: int = 51) -> set[tuple]:
    """(id, start, stop, words, first id) of each run of windows of `size` words that two ids have."""
    texts = sorted({(i, t or "") for i, t in rows if i is not None})
    owners = collections.defaultdict(set)
    for i, t in texts:
        w = WORD.findall(t)
        for k in range(len(w) - size + 1):
            owners[tuple(w[k : k + size])].add(i)
    out = set()
    for i, t in texts:
        spans = [m.span() for m in WORD.finditer(t)]
        w = [t[a:b] for a, b in spans]
        hits = [k for k in range(len(w) - size + 1) if len(owners[tuple(w[k : k + size])]) > 1]
        for k in hits:
            if k - 1 not in hits:
                end = k
                while end + 1 in hits:
                    end += 1
                first = min(min(owners[tuple(w[j : j + size])]) for j in range(k, end + 1))
                out.add((i, spans[k][0], spans[end + size - 1][1], end - k + size, first))
    return out


def passage_rows(df) -> set[tuple]:
    return {(r.doc_id, r.start, r.stop, r.n_words, r.first_doc) for r in df.collect()}


def test_phrases_of_other_documents_are_no_passage(spark):
    """Every 20 words of a document are in another one, but no two documents have more than 40 words together."""
    words = [f"{random.Random(k).choice('abcdefgh')}{random.Random(k).randrange(10**5)}" for k in range(300)]
    rows = [(0, " ".join(words))] + [(1 + k, " ".join([f"s{k}", *words[k : k + 40], f"t{k}"])) for k in range(0, 280, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert chunking.repeated_passages(docs).count() == 0


@pytest.mark.parametrize("letters", [1, 4, 7])
def test_passages_match_brute_force(spark, letters):
    """Passages of 50, 51, 52 and 60 words, short and long words, other spacing, repeated ids, nulls."""
    rng = random.Random(letters)
    prose = lambda n: ["".join(rng.choice("abcdefghijklmnopé") for _ in range(letters)) for _ in range(n)]
    rows = [(None, " ".join(["n"] * 60)), (900, None), (901, ""), (902, "n " * 60)]
    for k in range(60):
        shared = prose((50, 51, 52, 60)[k % 4])
        for copy in range(2):
            rows.append((2 * k + copy, (" ", "\n ")[copy].join(prose(rng.randint(0, 60)) + shared + prose(rng.randint(0, 60)))))
    rows += [(500, rows[6][1]), (500, rows[6][1]), (500, rows[9][1]), (501, " ".join(prose(30) * 4)), (501, " ".join(prose(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_passages(rows)
    assert len(want) > 80
    assert passage_rows(chunking.repeated_passages(docs)) == want


def test_passages_across_pieces_and_after_long_words(spark):
    """51 words at every place around a piece's end, and windows whose places need more than 16 bits."""
    rng = random.Random(3)
    prose = lambda n: [f"{rng.randrange(10**4):04d}" for _ in range(n)]
    shared = prose(51)
    lead = textkernel.PIECE // 5
    filler = prose(lead + 100)
    rows = [(k, " ".join(f"{k}{w}" for w in filler)[: textkernel.PIECE - 5 * back] + " " + " ".join(shared)) for k, back in enumerate((60, 51, 25, 1, 0))]
    rows += [(50, " ".join(["a", *prose(3)] + ["x" * 70_000] + shared)), (51, " ".join(["b"] + ["x" * 70_000] + shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert passage_rows(chunking.repeated_passages(docs)) == brute_passages(rows)


# decontamination


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 400 * 12, 400 * 200])
def test_contamination_matches_brute_force(spark, docs, rows, block_bytes):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, " ".join(WORD.findall(rows[3][1])[:25])), (2, " ".join(WORD.findall(rows[9][1])[5:40])), (10, "lorem ipsum"), (11, None), (12, "!?"), (2, "One"), (None, "éclair7"), (13, "lorem ipsum dolor")]
    found = decontaminate.contamination_report(decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[i : i + min(10, len(w))])].add(item)
    for r in found.collect():
        w = word.findall(lower(dict((x[0], x[1]) for x in rows)[r.doc_id]))
        hit, ids = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in ids - {None})
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))


def test_contamination_carries_columns(spark):
    """Extra columns of any name go along, but for those of the results; repeated rows and ids keep their rows."""
    docs = spark.createDataFrame([(1, "a b c d", "x", 7), (1, "a b c d", "x", 7), (2, None, None, 8), (None, "b c", "y", 9)], "doc_id long, text string, seen string, _x int")
    items = spark.createDataFrame([(5, "b c"), (6, "z")], "item_id long, text string")
    got = sorted(((r.doc_id, r.seen, r["_x"], r.n_words, r.hit_words, r.hit_items) for r in decontaminate.find_contamination(docs, items, carry=["doc_id", "seen", "_x"]).collect()), key=str)
    assert got == sorted([(1, "x", 7, 4, [[1, 3]], ["5"])] * 2 + [(2, None, 8, 0, [], []), (None, "y", 9, 2, [[0, 2]], ["5"])], key=str)
    clashing = decontaminate.find_contamination(docs.withColumnRenamed("seen", "hit_words").withColumnRenamed("_x", "_text"), items, carry=["doc_id", "hit_words", "_text"])
    assert clashing.columns == ["doc_id", "hit_words_carried", "_text", *decontaminate.ADDED]
    assert sorted((tuple(r) for r in clashing.collect()), key=str) == got


def test_no_benchmark(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination_report(decontaminate.find_contamination(docs, none)).collect())
    assert decontaminate.contamination_report(decontaminate.find_contamination(empty, none)).count() == 0
