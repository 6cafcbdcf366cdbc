"""Token store, whitening and turn repair against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from tideline.llm import queries, token_store, turn_repair, whitening
from tideline.llm.common import scratch

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def expected_tokens(rows):
    out, at = [], 0
    for doc_id, text in rows:
        ids = plain_ids(text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op11_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in queries.op11_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_tokens([tuple(r) for r in docs])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x85\xa0 ́ͅΣςsé'<|endoftext|>각")), max_size=30), min_size=1, max_size=6))
def test_words_apart_are_the_whole(texts):
    import pyarrow as pa

    encoder = token_store.word_encoder(open(VOCABULARY, "rb").read())
    got = [list(part) for _, _, ids, n in token_store.text_ids(encoder, pa.array(texts), 1) for part in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [plain_ids(t) for t in texts]


def test_long_texts_and_forgetting(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "CHUNK_BYTES", 200)
    monkeypatch.setattr(token_store, "REMEMBERED", 20)
    texts = [" ".join(f"word{i * 7 % 50} é{'x' * (i % 80)}" for i in range(300)), "", "y" * 5000, "  a\n" * 400 + "end <|endoftext|> of  text", "<|endoftext|>" * 30]
    encoder = token_store.WordEncoder(open(VOCABULARY, "rb").read())
    got = [list(part) for _, _, ids, n in token_store.text_ids(encoder, pa.array(texts), 1) for part in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [plain_ids(t) for t in texts]


def test_token_store_edge_cases(spark):
    rows = [(3, "b c"), (None, "null id"), (1, None), (3, "b c"), (2, ""), (3, "a"), (9, "zz " * 5000)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, ids string, part int").repartition(3)
    path = scratch(spark, "t")
    token_store.write_tokens(docs, path, VOCABULARY, parts=3)
    got = sorted((tuple(r) for r in token_store.token_report(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 3, 9]
    three = [r[1:] for r in rows if r[0] == 3]
    orders = [[("null id",), (None,), ("",), *x, ("zz " * 5000,)] for x in ([("a",), *three[:2]], [*three[:2], ("a",)])]
    ids = [None, 1, 2, 3, 3, 3, 9]
    assert got in [expected_tokens([(i, t[0]) for i, t in zip(ids, o, strict=True)]) for o in orders]
    empty = scratch(spark, "t")
    token_store.write_tokens(docs.limit(0), empty, VOCABULARY)
    assert token_store.token_report(spark, empty).count() == 0
    with pytest.raises(ValueError):
        token_store.write_tokens(docs, path, VOCABULARY, encoding="plain")


@pytest.mark.parametrize("encoding", token_store.ENCODINGS)
def test_token_files(spark, encoding):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = scratch(spark, "t")
    token_store.write_tokens(docs, path, VOCABULARY, encoding=encoding, parts=2, group_bytes=64 << 10, page_bytes=8 << 10)
    files = sorted({r.f for r in spark.read.parquet(f"{path}/docs").select(F.input_file_name().alias("f")).collect()})
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert column.has_dictionary_page == (encoding == "dictionary")
                    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
                elif column.path_in_schema != "part":
                    assert "DELTA_BINARY_PACKED" in column.encodings
    every = {r.doc_id: plain_ids(r.text) for r in docs.collect()}
    flat = [i for d in sorted(every) for i in every[d]]
    low, high = len(flat) // 3, len(flat) // 2
    got = sorted(token_store.read_tokens(spark, path, low, high).collect(), key=lambda r: r.start)
    assert got[0].start == low and [i for r in got for i in r.ids] == flat[low:high]
    ranged = token_store.read_range(spark, path, 20, 30)
    assert {r.doc_id: r.ids for r in ranged.collect()} == {d: every[d] for d in every if 20 <= d <= 30}
    plan = ranged._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan
    assert "ids" not in token_store.read_metadata(spark, path)._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def whitened_by_integers(vectors, components=8):
    """(n, deviations, whitened, explained) from Python integers."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    z = [[n * v[j] - s[j] for j in range(d)] for v in x]
    cov = np.array([[sum(v[i] * v[j] for v in z) / n**3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    w = (np.array(z, float) / n) @ axes[:, order] / np.sqrt(values[order])
    return n, [sum(c * c for c in v) for v in z], w, values[order] / values.sum()


def test_op12_against_integers(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, deviation, w, explained = whitened_by_integers(list(vectors.values()))
    got = queries.op12_whitening(spark, SF).toPandas().pivot(index="vec_id", columns="component")
    got = got.loc[list(vectors)]
    assert (got["n"] == n).all().all() and all((got["deviation"][k].to_numpy() == np.array(deviation)).all() for k in range(1, 9))
    mine = got["whitened"].to_numpy()
    assert np.allclose(mine * np.sign((mine * w).sum(0)), w, rtol=1e-8, atol=1e-8)
    assert np.allclose(got["explained"].iloc[0].to_numpy(), explained, rtol=1e-9)
    assert got["identity_error"].nunique().max() == 1 and got["identity_error"].max().max() < 1e-9


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(1)
    # extra columns clash with the operator's own; lengths are whitened apart
    rows = [(i, [float(a), float(b), float(a)]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)) * 1e9)]
    rows += [(None, rows[0][1]), (3, rows[1][1]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1e300, 0.0, 0.0]), (60, [1.0]), (61, [1.0]), (62, [0.0, 1.0]), (63, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, whitened double, dims int").repartition(3)
    got = whitening.whiten(df).toPandas()
    three = got[got.dims == 3]
    assert set(three.n) == {42} and len(three) == 42 * 3 and three.vec_id.isna().sum() == 3 and (three.vec_id == 3).sum() == 6
    _, deviation, w, _ = whitened_by_integers([v for i, v in rows if v and len(v) == 3 and i not in (52, 53, 54, 55)])
    assert sorted(map(int, three[three.component == 1].deviation)) == sorted(deviation)
    assert three[three.component == 3].whitened.isna().all() and three[three.component < 3].identity_error.max() < 1e-9
    assert np.allclose(sorted(abs(three[three.component == 1].whitened)), sorted(abs(w[:, 0])))
    one = got[got.dims == 1]
    assert one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all() and set(map(int, one.deviation)) == {0}
    two = got[(got.dims == 2) & (got.component == 1)]
    assert sorted(round(abs(v), 9) for v in two.whitened) == [1.0, 1.0]
    assert whitening.whiten(df.limit(0)).count() == 0
    single = whitening.whiten(df.where("vec_id = 60")).toPandas()
    assert len(single) == 1 and single.whitened.isna().all()


def test_remainders():
    for value in (0, 1, -1, 10**30, -(10**37) + 3):
        primes = whitening.primes_for(abs(value) + 1)
        assert whitening.reconstructed([value % p for p in primes], primes) == value
        assert all(p < whitening.PRIME_BELOW and all(p % k for k in range(2, 1100)) for p in primes)


def expected_repair(rows):
    """The report of one conversation's original rows (conv_id, turn, role, text)."""
    after = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, faults = set(), []
    for _, role, text in after:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for t, _, _ in after if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    best = [{} for _ in range(len(after) + 1)]
    for i in range(len(after), -1, -1):
        ends = {s: [(0, "", "")] if i == len(after) and s in ("", "a") else [] for s in follows}
        for s, found in ends.items():
            if i < len(after):
                _, role, text = after[i]
                cut = faults[i] == "truncated"
                line = lambda r, t: f"{r}:{t}\n"
                cost, audit, body = best[i + 1][s]
                found.append((3 + cost, "D" + audit, body))
                if faults[i] not in ("blank", "duplicate"):
                    if role[:1] and role[:1] in follows[s]:
                        cost, audit, body = best[i + 1][role[:1]]
                        found.append((cut + cost, "K" + audit, line(role, text) + body))
                    for r in ("user", "assistant"):
                        if r[0] in follows[s]:
                            cost, audit, body = best[i + 1][r[0]]
                            found.append((2 + cut + cost, "R" + audit, line(r, text) + body))
        for _ in range(3):  # insertions, as often as they can help
            for s in follows:
                for r in ("user", "assistant"):
                    if r[0] in follows[s] and ends[r[0]]:
                        cost, audit, body = min(ends[r[0]])
                        ends[s].append((2 + cost, "I" + audit, f"{r}:\n" + body))
        best[i] = {s: min(x) for s, x in ends.items()}
    cost, audit, body = best[0][""] if after else (0, "", "")
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(body.removesuffix("\n").encode()).hexdigest()


def check_repair(df):
    groups = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r.conv_id, []).append(tuple(r))
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_report(df).collect()}
    assert got.keys() == groups.keys()
    for conv, rows in groups.items():
        assert got[conv] == expected_repair(rows), conv


def test_op13_whole_table(spark):
    check_repair(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_repair_of_pieces(spark, monkeypatch):
    """Conversations over many pieces and tasks come out as in one; and all kinds of odd rows."""
    rng = np.random.default_rng(3)
    roles, texts = ["user", "assistant", "system", "tool", "", "ua", None], ["Yes.", "No", " ", "Go on!\n", "", None, "A b. c", "éh?\t", "end.\xa0"]
    rows = [(0, t, roles[rng.integers(3)], f"{texts[rng.integers(8)]}{rng.integers(40)}.") for t in range(900)]
    rows += [(c, int(t), roles[rng.integers(7)], texts[rng.integers(9)] if rng.random() < 0.5 else f"text {t}.") for c in range(1, 60) for t in range(rng.integers(1, 12))]
    rows += [(None, None, "user", "a."), (None, None, "assistant", "b."), (None, 4, None, None), (77, None, "user", "x."), (78, 1, "user", "same."), (78, 1, "user", "same."), (78, 1, "user", "same."), (79, -3, "user", "x."), (79, 8, "assistant", "y.")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, kind string").repartition(3)
    check_repair(df)
    cut = turn_repair.pieces(turn_repair.faulty(turn_repair.damaged(df)))
    assert cut.where("conv_id = 0").count() > 1  # more than PIECE turns
    edited, _ = turn_repair.repair(turn_repair.checkpoint(cut))
    turns = turn_repair.repaired_turns(edited).where("conv_id = 0 and edit <> 'D'").orderBy("part", "k", "place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns))
    assert turn_repair.repair_report(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9), st.integers(1, 4))
def test_split_programme(turns, width):
    """Costs by matrices of pieces are those of the whole."""
    codes = np.array([k + 4 * f for k, f in turns], np.int64)[:, None]
    end = turn_repair.AT_END[None, :, None].astype(np.int32)
    whole = turn_repair.backward(codes, np.array([len(turns)]), end)[0, 0, :, 0]
    after = turn_repair.AT_END.astype(np.int64)
    eye = np.where(np.eye(4, dtype=bool), 0, turn_repair.NEVER).astype(np.int32)[None]
    for lo in reversed(range(0, len(turns), width)):
        part = codes[lo : lo + width]
        after = (turn_repair.backward(part, np.array([len(part)]), eye)[0, 0] + after).min(1)
    assert whole.tolist() == after.tolist()
