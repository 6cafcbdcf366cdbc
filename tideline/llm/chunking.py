"""Substring deduplication by content-defined chunking with a gear rolling hash over words.

The gear hash of a word depends on it and the GEAR - 1 words before it only. A word is a border if its gear hash is the least
(the first of equals) of some run of `reach` words; so borders move with the text, at most `reach` words apart. A chunk
is the text behind a border up to the next one, of a length that its content sets, and is known by a 64-bit digest of all
its words. Chunks whose digest two documents have are repeats.

`reach` is chosen so that every window of PASSAGE words, the shortest passage that counts, has two borders that are told
by its own words alone: it holds a whole chunk, the same wherever it stands. So no passage is lost if only repeated chunks
are looked at further. How far a repeat goes beyond its chunks is measured by windows: each belongs to its first
whole chunk, and those of repeated chunks are compared by digests of their own. All words of a
passage stand together in another document, and its extent is exact. Only digests and places are shuffled, never
texts. Collisions (two of 2**64) are the only approximation.

Defined results: words are runs of anything but ASCII white space, so how they are spaced does not matter; null and empty texts
have no chunks; rows with a null id take no part; rows with the same id count as one document, so what repeats only
within it is not shared, and the same text twice under one id counts once. A passage is a run of consecutive shared
windows; those of one passage may be shared with different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import _INV, SPACE_SEPARATORS, _powers, chunks, mix, words

#: Words of the shortest passage: over 50.
PASSAGE = 51
#: Words that a gear hash depends on: of 32 bits, eight leave with each word.
GEAR = 4

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A digest of each run of n hashes, found in doubling steps."""
    power, width, done, out = h, 1, 0, None
    while True:
        if n & width:
            if out is None:
                out = power
            else:
                m = len(h) - done - width + 1
                out = out[:m] * np.uint64(pow(_BASE, width, _MASK + 1)) + power[done : done + m]
            done += width
        if done == n:
            return mix(out[: len(h) - n + 1])
        power = power[:-width] * np.uint64(pow(_BASE, width, _MASK + 1)) + power[width:]
        width *= 2


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n keys."""
    width = 1
    while 2 * width <= n:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = n - width
    return np.minimum(key[: len(key) - rest], key[rest:])


def reach(size: int) -> int:
    """Words of a run whose least gear hash is a border: a window of `size` words has two runs without a word in common."""
    return (size - GEAR + 1) // 2


def borders(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two borders in each window of `size` words, from the hashes of all words. Between them is the window's first chunk."""
    gear = (mix(h) >> np.uint64(32)).astype(np.uint32)
    for k in (1, 2):
        gear[k:] = gear[k:] + (gear[:-k] << np.uint32(8 * k))
    key = (gear.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    named = (_least(key[GEAR - 1 :], reach(size)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, named[1:] != named[:-1])
    after = np.append(named[new][1:], -1)[np.cumsum(new) - 1]
    n = len(h) - size + 1
    return named[:n], after[:n]


def chunk_digests(h: np.ndarray, border: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A digest of all words behind each border up to the one after it."""
    running = np.append(np.uint64(0), np.cumsum(h * _powers(_BASE, len(h))))
    content = (running[after + 1] - running[border + 1]) * _powers(_INV, len(h) + 1)[border + 1]
    # lengths are told apart by values that no short word has
    return mix(content ^ mix((after - border).astype(np.uint64) + np.uint64(_BASE)))


def _window_lists(digest: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Of each chunk a list of the digests of its n windows, then of their places (start and size): two to a number, or, where `far`, one
    to a number. Lists have n + ceil(n / 2) numbers then, or 2 * n. `owner` is the chunk of each window, `first` its first window."""
    at, n = np.arange(len(owner)) - first[owner], np.diff(np.append(first, len(owner)))
    far = np.bincount(owner, (start >= 1 << 15) | (size >= 1 << 16), len(first)) > 0
    offset = np.append(0, np.cumsum(n + np.where(far, n, (n + 1) // 2)))
    values = np.zeros(offset[-1], np.int64)
    values[offset[owner] + at] = digest.view(np.int64)
    behind, apart = offset[owner] + n[owner], far[owner]
    values[(behind + at)[apart]] = ((start << 32) | size)[apart]
    values.view("<i4")[(2 * behind + at)[~apart]] = ((start << 16) | size)[~apart]
    return pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(values)), far


def _chunk_rows(batches: Iterator[pa.RecordBatch], whole: bool, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, doc_id) of the chunks, or with `whole` also (body, origin, windows): a digest of the text, the number of the first
    window's first word and where that starts (all bits turned where places are far apart), and the lists of windows."""
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            w = words(chunk, SPACE_SEPARATORS)
            if len(w.hash) < size:
                continue
            inside = np.flatnonzero(w.row[: len(w.row) - size + 1] == w.row[size - 1 :])
            if not len(inside):
                continue
            border, after = (x[inside] for x in borders(w.hash, size))
            first = np.flatnonzero(np.append(True, (border[1:] != border[:-1]) | (w.row[inside[1:]] != w.row[inside[:-1]])))
            digest = chunk_digests(w.hash, border[first], after[first])
            row = w.row[inside[first]]
            columns = [pa.array(digest.view(np.int64)), batch.column(0).take(pa.array(row + chunk.lo))]
            if not whole:
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id"])
                continue
            number = np.arange(len(w.hash)) - w.first[w.row]
            running = np.append(np.uint64(0), np.cumsum(mix(w.hash ^ mix(number.astype(np.uint64) + np.uint64(1)))))
            body = mix(running[w.first[1:]] - running[w.first[:-1]])[row]
            chars = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))
            zero = chars[chunk.begin][w.row[inside]]
            start, stop = chars[w.start[inside]] - zero, chars[w.stop[inside + size - 1]] - zero
            # places are told from the first window's start, so that they are small numbers
            begin = start[first]
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(inside))))
            windows, far = _window_lists(_grams(w.hash, size)[inside], start - begin[owner], stop - start, owner, first)
            origin = (number[inside[first]] << 32) | begin
            columns += [pa.array(body.view(np.int64)), pa.array(np.where(far, ~origin, origin)), windows]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "body", "origin", "windows"])


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """Passages of at least `passage` words that other documents have too: doc_id, start and stop (code points), n_words, n_chunks,
    and first_doc, the smallest id of a document that has `passage` words of it. Documents without such a passage have no row."""
    if passage <= GEAR:
        raise ValueError(f"a passage has more than {GEAR} words")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    kind = source.schema["doc_id"].dataType.simpleString()
    brief = source.mapInArrow(lambda it: _chunk_rows(it, False, passage), f"chunk bigint, doc_id {kind}")
    shared = brief.groupBy("chunk").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("chunk")
    whole = source.mapInArrow(lambda it: _chunk_rows(it, True, passage), f"chunk bigint, doc_id {kind}, body bigint, origin bigint, windows array<bigint>")
    # dealt by chunk once: equal windows are in one chunk, so all windows and groups up to the next deal use that
    far, low = F.col("origin") < 0, F.lit((1 << 32) - 1)
    origin = F.when(far, F.bitwise_not("origin")).otherwise(F.col("origin"))
    n = F.when(far, F.size("windows") / 2).otherwise(F.floor(F.size("windows") * 2 / 3)).cast("int")
    each = whole.join(shared.hint("merge"), "chunk").withColumns({"n": n, "far": far, "word": F.shiftright(origin, 32).cast("int"), "begin": origin.bitwiseAND(low).cast("int")})
    each = each.select("chunk", "doc_id", "body", "word", "begin", "n", "far", "windows", F.posexplode(F.slice("windows", F.lit(1), F.col("n"))).alias("at", "digest"))
    pair = F.get("windows", F.col("n") + F.shiftright("at", 1))
    place = F.when(F.col("at").bitwiseAND(F.lit(1)) == 1, F.shiftrightunsigned(pair, 32)).otherwise(pair.bitwiseAND(low))
    wide = F.get("windows", F.col("n") + F.col("at"))
    start = F.col("begin") + F.when(F.col("far"), F.shiftright(wide, 32)).otherwise(F.shiftright(place, 16)).cast("int")
    length = F.when(F.col("far"), wide.bitwiseAND(low)).otherwise(place.bitwiseAND(F.lit((1 << 16) - 1))).cast("int")
    each = each.select("chunk", "digest", "doc_id", "body", "word", (F.col("word") + F.col("at")).alias("lo"), start.alias("start"), (start + length).alias("stop"))
    copies = Window.partitionBy("chunk", "digest")
    found = each.withColumn("first_doc", F.min("doc_id").over(copies)).withColumn("last_doc", F.max("doc_id").over(copies)).where("first_doc < last_doc")
    order = Window.partitionBy("chunk", "doc_id", "body", "word").orderBy("lo")
    # lo - rank is the same for consecutive windows, also where a text occurs twice
    found = found.withColumn("island", F.col("lo") - F.dense_rank().over(order))
    parts = found.groupBy("chunk", "doc_id", "body", "word", "island").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc").alias("first_doc"))
    inner = Window.partitionBy("doc_id", "body").orderBy("lo", "hi")
    parts = parts.select("doc_id", "body", "lo", "hi", "start", "stop", "first_doc").repartition("doc_id")
    parts = parts.withColumn("run", F.sum(F.when(F.lag("hi").over(inner) == F.col("lo") - 1, 0).otherwise(1)).over(inner))
    runs = parts.groupBy("doc_id", "body", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("hi") - F.min("lo") + passage).cast("bigint").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc").alias("first_doc"))
    return runs.select("doc_id", "start", "stop", "n_words", "n_chunks", "first_doc")
