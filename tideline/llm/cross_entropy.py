"""Cross-entropy difference of documents under matched target and background n-gram models.

Words are cut into pieces of WIDTH characters, which are the vocabulary of both models; it is whatever all documents have. Both are
bigram models of pieces, a boundary standing before and after each text. The background is every document that is not in the
target; its counts are scaled to the target's total, so that equal smoothing weighs equally in both. A bigram's counts are
mixed with those of its last piece, and these with the frequency of the piece in all documents, by Dirichlet weights. An
occurrence is scored without what it adds to the counts itself, so that no text is told by heart. A document's score is the mean over
its pieces of target loss minus background loss: lower is more like the target.

Documents are dealt to chunks of about CHUNK_BYTES by a hash of their id. A chunk counts its distinct n-grams, counts of all
chunks meet by n-gram (a frequent one has a row per chunk, not per occurrence), and go back to the chunks that asked; nothing
is collected but two sums, and no model is ever in one place.

Defined results: null and blank texts have no pieces, losses and score 0; without target documents, or without others, scores are 0;
labels of ids without a document do nothing; repeated rows count as often as they occur; a null id is never in the target; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import ASCII_LOWER, BYTE_VALUES, SPACE_SEPARATORS, Chunk, chunks, mix

#: Characters of a piece; text bytes that are counted together; weight of the shorter model in each context.
WIDTH, CHUNK_BYTES, PRIOR = 3, 16 << 20, 4.0
#: A factor for each byte of a piece; a character has up to four.
_POWERS = np.multiply.accumulate(np.full(4 * 16, 0x9E3779B97F4A7C15 | 1, np.uint64))
#: Occurrences that are scored in one step.
_STEP = 1 << 20
#: The boundary as a piece, and the row that holds a chunk's totals.
_BOUNDARY, _TOTAL = np.uint64(1), np.uint64(2)


def pieces(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the pieces of every text: words are cut after each WIDTH characters; a word's first piece is marked."""
    data = ASCII_LOWER[chunk.data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[chunk.begin] = edge[chunk.end] = True
    word = ~SPACE_SEPARATORS[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    lead = (data & 0xC0) != 0x80
    place = np.cumsum(lead, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(opens, place, 0))
    cut = word & lead & (place % WIDTH == 0) | opens
    stops = np.append(np.flatnonzero(cut | ~word | edge[:n]), n)
    start = np.flatnonzero(cut)
    size = stops[np.searchsorted(stops, start, side="right")] - start
    h = np.where(opens[start], np.uint64(7), np.uint64(3)) + size.astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        h[live] += BYTE_VALUES[data[start[live] + k]] * _POWERS[k]
    row = np.searchsorted(chunk.begin, start, side="right") - 1
    inside = start < chunk.end[row]
    return mix(h[inside]) | np.uint64(4), row[inside]


@dataclass
class Coded:
    """The predicted pieces of some texts, each closing boundary included: row, number of the piece and of the pair with the piece
    before; and the keys of the numbered pieces and pairs. Piece 0 is the boundary."""

    row: np.ndarray
    last: np.ndarray
    pair: np.ndarray
    pieces: np.ndarray
    pairs: np.ndarray
    #: the piece before, of each pair
    before: np.ndarray


def _coded(texts: pa.Array) -> Coded:
    rows, lasts, firsts, total = [], [np.full(1, _BOUNDARY)], [], 0
    for chunk in chunks(texts):
        h, row = pieces(chunk)
        count = np.bincount(row, minlength=len(chunk.begin))
        some = count > 0
        end = np.cumsum(count + some)
        last = np.full(int(end[-1]), _BOUNDARY)
        inner = np.ones(len(last), bool)
        inner[end[some] - 1] = False
        last[inner] = h
        rows.append((np.repeat(np.arange(len(count)), count + some) + chunk.lo).astype(np.int32))
        lasts.append(last)
        firsts.append((end - count - some)[some] + total)
        total += len(last)
    number, keys = pd.factorize(np.concatenate(lasts))
    number = number[1:]
    context = np.empty(total, np.int64)
    context[1:] = number[:-1]
    context[np.concatenate(firsts) if firsts else np.zeros(0, np.int64)] = 0
    pair, packed = pd.factorize((context << 32) | number)
    keys = np.asarray(keys, np.uint64)
    packed = np.asarray(packed, np.int64)
    joined = mix(mix(keys[packed >> 32]) + keys[packed & 0xFFFFFFFF]) | np.uint64(4)
    return Coded(np.concatenate(rows) if rows else np.zeros(0, np.int32), number.astype(np.int32), pair.astype(np.int32), keys, joined, packed >> 32)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _in_target(docs: pa.Table, ids: pa.Array) -> np.ndarray:
    return pc.is_in(_column(docs, "doc_id"), value_set=ids.drop_null()).to_numpy(zero_copy_only=False)


def _count(key: tuple, docs: pa.Table, ids: pa.Table) -> pa.Table:
    """The distinct n-grams of a chunk with their counts in the target's documents and in the others."""
    x = _coded(_column(docs, "text"))
    wanted = _in_target(docs, _column(ids, "doc_id"))[x.row]
    gram = np.concatenate([x.pieces, x.pairs, [_TOTAL]])

    def counts(of: np.ndarray) -> np.ndarray:
        last, pair = np.bincount(x.last[of], minlength=len(x.pieces)), np.bincount(x.pair[of], minlength=len(x.pairs))
        return np.concatenate([last, pair, [of.sum()]])

    return pa.table({"chunk": pa.array(np.full(len(gram), key[0].as_py(), np.int64)), "gram": pa.array(gram.view(np.int64)), "n_target": pa.array(counts(wanted)), "n_rest": pa.array(counts(~wanted))})


def _score(key: tuple, docs: pa.Table, model: pa.Table) -> pa.Table:
    x = _coded(_column(docs, "text"))
    member = _in_target(docs, _column(model, "doc_id"))
    known = model.filter(pc.is_valid(model.column("gram")))
    gram = _column(known, "gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    gram, sides = gram[order], [_column(known, c).to_numpy()[order].astype(float) for c in ("n_target", "n_rest")]
    size = np.bincount(x.row, minlength=docs.num_rows)
    losses = np.zeros((2, docs.num_rows))
    if len(x.row):
        pieces_at, pairs_at = np.searchsorted(gram, x.pieces), np.searchsorted(gram, x.pairs)
        total = [float(c[np.searchsorted(gram, _TOTAL)]) for c in sides]
        scales = (float(total[1] > 0), total[0] / total[1] if total[1] else 0.0)
        every = (sides[0] + sides[1])[pieces_at] / sum(total)
        for side, (counts, whole, scale) in enumerate(zip(sides, total, scales, strict=True)):
            of_piece, of_pair = counts[pieces_at], counts[pairs_at]
            belongs = member if side == 0 else ~member
            for lo in range(0, len(x.row), _STEP):
                row, last, pair = (c[lo : lo + _STEP] for c in (x.row, x.last, x.pair))
                mine = belongs[row].astype(float)
                p = ((of_piece[last] - mine) * scale + PRIOR * every[last]) / ((whole - mine) * scale + PRIOR)
                p = ((of_pair[pair] - mine) * scale + PRIOR * p) / ((of_piece[x.before[pair]] - mine) * scale + PRIOR)
                losses[side] += np.bincount(row, -np.log(p), len(size))
    losses /= np.maximum(size, 1)
    return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(size.astype(np.int64)), "target_loss": pa.array(losses[0]), "background_loss": pa.array(losses[1]), "score": pa.array(losses[0] - losses[1])})


def cross_entropy_difference(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_tokens (pieces and the closing boundary), target_loss, background_loss and score; `target` has the ids
    (column `doc_id`) of the target's documents."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n_chunks = int((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES) + 1

    def dealt(spread: Column) -> Column:
        return F.pmod(spread, F.lit(n_chunks)).alias("chunk")

    texts = own.select("doc_id", "text", dealt(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))))
    ids = target.select(F.col("doc_id").cast(own.schema["doc_id"].dataType).alias("doc_id")).where("doc_id is not null").distinct().withColumn("chunk", dealt(F.xxhash64("doc_id")))
    counted = texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_count, "chunk bigint, gram bigint, n_target bigint, n_rest bigint")
    same = Window.partitionBy("gram")
    none = F.lit(None)
    model = counted.select("chunk", "gram", F.sum("n_target").over(same).alias("n_target"), F.sum("n_rest").over(same).alias("n_rest"), none.cast(own.schema["doc_id"].dataType).alias("doc_id"))
    model = model.unionByName(ids.select("chunk", none.cast("bigint").alias("gram"), none.cast("bigint").alias("n_target"), none.cast("bigint").alias("n_rest"), "doc_id"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score")]])
    return texts.groupBy("chunk").cogroup(model.groupBy("chunk")).applyInArrow(_score, schema)
