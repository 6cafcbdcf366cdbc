"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of `window` consecutive words of a benchmark item (or the whole item, if it is shorter) is a
pattern. Documents are read once, word by word hash; a block shift table says how many words can be
skipped, a bucket of the patterns' suffix blocks selects the few patterns that may end at a position, and a
direct comparison of all their words confirms an occurrence.

The patterns are the only thing sent to the tasks, as flat arrays. They are taken in blocks whose arrays have at most about
`block_bytes` (reckoned from the items' words before they are read; an item that is larger than a block is cut into pieces
that overlap by a window less one word). With one block documents are read once, and nothing is shuffled. With more, documents are written
once with a number for each row, and each block has a pass over them of its own, a job that writes only the rows it hits; one block is made,
sent and dropped before the next, and the hits of all blocks are joined to their rows at the end. So memory does not grow with the benchmark,
on the driver or in tasks; the time does.
"Direct comparison" is of 64-bit word hashes, all of them; two of 2**64 are the only approximation.

Defined results: null or wordless texts have no words and no hits; an item without words has no window; an item
with a null id can hit words but is never listed; repeated rows each get their own result row; other columns play no part, and a
carried column that has a result's name is returned with `_carried` behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint
from .textkernel import ASCII_LOWER, SYMBOL_SEPARATORS, chunks, mix, words

#: Bytes of a block's arrays, at most about; bytes that a window's arrays and its share of the tables take.
BLOCK_BYTES, WINDOW_BYTES = 64 << 20, 400
_LANE = 256


class PatternSearch:
    """Wu-Manber search for word sequences that all have at least `self.least` words: pattern k is flat[first[k] : first[k] + lengths[k]]."""

    def __init__(self, flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.first, self.lengths = flat, first, lengths
        self.least = int(lengths.min())
        self.block = 2 if self.least >= 2 else 1
        bits = int(np.clip(np.ceil(np.log2(len(first) * self.least * 8)), 10, 24))
        self.mask = np.uint64((1 << bits) - 1)
        most = self.least - self.block + 1
        self.shift = np.full(1 << bits, min(most, 255), np.uint8)
        for j in range(most):  # block that starts at word j of the first `least` words
            key = self._key([self.flat[self.first + j + i] for i in range(self.block)])
            np.minimum.at(self.shift, (key & self.mask).astype(np.int64), min(most - 1 - j, 255))
        suffix = self._key([self.flat[self.first + self.least - self.block + i] for i in range(self.block)])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _key(self, block: list[np.ndarray]) -> np.ndarray:
        key = block[0]
        for part in block[1:]:
            key = mix(key) + part
        return mix(key)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in a sequence of word hashes."""
        last = len(text) - self.least
        none = np.zeros(0, np.int64)
        if last < 0:
            return none, none
        pos = np.arange(0, last + 1, _LANE)
        stop = np.minimum(pos + _LANE, last + 1)
        starts, keys = [], []
        tail = self.least - self.block
        while len(pos):  # all lanes advance together, each by its own shift
            key = self._key([text[pos + tail + i] for i in range(self.block)])
            step = self.shift[(key & self.mask).astype(np.int64)].astype(np.int64)
            hit = step == 0
            if hit.any():
                starts.append(pos[hit])
                keys.append(key[hit])
            pos = pos + np.maximum(step, 1)
            alive = pos < stop
            pos, stop = pos[alive], stop[alive]
        if not starts:
            return none, none
        start, key = np.concatenate(starts), np.concatenate(keys)
        lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        count = hi - lo
        start = np.repeat(start, count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which = self.order[np.repeat(lo, count) + within]
        keep = start + self.lengths[which] <= len(text)
        start, which = start[keep], which[keep]
        for j in range(int(self.lengths.max(initial=0))):
            live = self.lengths[which] > j
            same = ~live
            same[live] = text[start[live] + j] == self.flat[self.first[which[live]] + j]
            start, which = start[same], which[same]
        return start, which


def _windows(flat: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit digest of the `size` words from each place on."""
    key = np.zeros(len(first), np.uint64)
    for j in range(size):
        key = mix(key) + flat[first + j]
    return mix(key)


class Patterns:
    """Distinct windows of benchmark items, with the items that each belongs to: owners of window k are owner[owner_first[k] : owner_first[k + 1]]."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.ids: list[str | None] = []
        sequences = []
        for item_id, text in items:
            [chunk] = chunks(pa.array([text], pa.large_string()), 1 << 62)
            seq = words(chunk, SYMBOL_SEPARATORS, ASCII_LOWER).hash
            if len(seq):
                self.ids.append(None if item_id is None else str(item_id))
                sequences.append(seq)
        self.groups: list[tuple[PatternSearch, np.ndarray, np.ndarray]] = []
        if not sequences:
            return
        flat = np.concatenate(sequences)
        count = np.array([len(s) for s in sequences])
        begin = np.cumsum(count) - count
        size = np.minimum(count, window)
        per = count - size + 1
        item = np.repeat(np.arange(len(count)), per)
        first = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        for own in (np.flatnonzero(size[item] == window), np.flatnonzero(size[item] < window)):
            if not len(own):
                continue
            lengths = size[item[own]]
            digest = np.empty(len(own), np.uint64)
            for n in np.unique(lengths):
                at = lengths == n
                digest[at] = _windows(flat, first[own[at]], int(n)) + np.uint64(n)
            _, place, number = np.unique(digest, return_index=True, return_inverse=True)
            order = np.lexsort((item[own], number))
            number, owner = number[order], item[own][order]
            new = np.append(True, (number[1:] != number[:-1]) | (owner[1:] != owner[:-1]))
            number, owner = number[new], owner[new]
            self.groups.append((PatternSearch(flat, first[own[place]], lengths[place]), owner, np.append(np.searchsorted(number, np.arange(len(place))), len(number))))

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length) of all occurrences, and (start, item) of what they stand for."""
        none = np.zeros(0, np.int64)
        starts, lengths, places, items = [none], [none], [none], [none]
        for group, owner, owner_first in self.groups:
            start, which = group.find(text)
            starts.append(start)
            lengths.append(group.lengths[which])
            count = owner_first[which + 1] - owner_first[which]
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            places.append(np.repeat(start, count))
            items.append(owner[np.repeat(owner_first[which], count) + within])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(places), np.concatenate(items)


def _covered(start: np.ndarray, length: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of words inside any occurrence."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    inside = np.concatenate([[False], np.cumsum(change) > 0])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _search_batches(batches: Iterator[pa.RecordBatch], patterns: Patterns, hits_only: bool) -> Iterator[pa.RecordBatch]:
    """From rows (text, row) to (row, n_words, hit_words, hit_items), of all rows or of those with hits."""
    for batch in batches:
        hits: list[list] = [[] for _ in range(batch.num_rows)]
        named: list[list] = [[] for _ in range(batch.num_rows)]
        counts = np.zeros(batch.num_rows, np.int64)
        for chunk in chunks(batch.column(0)):
            w = words(chunk, SYMBOL_SEPARATORS, ASCII_LOWER)
            per_row = np.diff(w.first)
            counts[chunk.lo : chunk.hi] = per_row
            # one word that no pattern has between any two rows
            apart = np.zeros(len(w.hash) + len(per_row), np.uint64)
            apart[np.arange(len(w.hash)) + w.row] = w.hash
            row_at = w.first[:-1] + np.arange(len(per_row))
            start, length, place, item = patterns.search(apart)
            if not len(start):
                continue
            row_of = lambda x, row_at=row_at: np.searchsorted(row_at, x, side="right") - 1
            begin, end = _covered(start, length, len(apart))
            row = row_of(begin)
            for r, a, b in zip(row.tolist(), (begin - row_at[row]).tolist(), (end - row_at[row]).tolist(), strict=True):
                hits[chunk.lo + r].append([a, b])
            for key in np.unique(row_of(place) * len(patterns.ids) + item).tolist():
                r, i = divmod(key, len(patterns.ids))
                if patterns.ids[i] is not None:
                    named[chunk.lo + r].append(patterns.ids[i])
        named = [sorted(set(x)) if len(x) > 1 else x for x in named]
        out = pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string()))], names=["row", *ADDED])
        yield out.filter(pa.array([bool(x) for x in hits], pa.bool_())) if hits_only else out


ADDED = ("n_words", "hit_words", "hit_items")


def _pieces(items: DataFrame, window: int, most_words: int) -> DataFrame:
    """Items (id, text); one of more than `most_words` words is cut into pieces that overlap by a window less one word."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    long = items.where(F.octet_length("text") > 2 * most_words)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = long.select("id", F.regexp_extract_all(lower, F.lit(word), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(most_words))
    cut = cut.where(F.size("w") > 0).select("id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(most_words + window - 1)), " "))).alias("text"))
    return items.where(F.octet_length("text") <= 2 * most_words).unionByName(cut)


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns `carry` (default doc_id) of every document with

    n_words (long), hit_words (disjoint [begin, end) word ranges that occurrences cover) and
    hit_items (sorted ids, as text, of the items with an occurring window).
    """
    carry = list(carry or ["doc_id"])
    wanted = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    # a word has two bytes of text with its separator, at least, and starts one window at most
    most_words = max(1, block_bytes // WINDOW_BYTES)
    wanted = _pieces(wanted, window, most_words)
    total = wanted.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = int(total // (2 * most_words)) + 1
    rows = docs.select(F.col(text_column).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"))
    found = _one_block(rows, wanted, window) if blocks == 1 else _many_blocks(rows, wanted, window, blocks)
    return found.select(*[F.col("row").getField(f"c{i}").alias(f"{c}_carried" if c in ADDED else c) for i, c in enumerate(carry)], *ADDED)


def _searched(rows: DataFrame, patterns: Broadcast, hits_only: bool) -> DataFrame:
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(lambda it: _search_batches(it, patterns.value, hits_only), T.StructType([rows.schema["row"], *added]))


def _one_block(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    patterns = Patterns([(r.id, r.text) for r in items.collect()], window)  # a block's items, which are bounded
    return _searched(rows, rows.sparkSession.sparkContext.broadcast(patterns), False)


def _many_blocks(rows: DataFrame, items: DataFrame, window: int, blocks: int) -> DataFrame:
    """The same in passes, one for each block."""
    items = checkpoint(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))))
    rows = checkpoint(rows.withColumn("number", F.monotonically_increasing_id()))
    numbered = rows.select("text", F.col("number").alias("row"))
    hits = []
    for b in range(blocks):
        patterns = Patterns([(r.id, r.text) for r in items.where(F.col("block") == b).select("id", "text").collect()], window)
        shared = rows.sparkSession.sparkContext.broadcast(patterns)
        hits.append(checkpoint(_searched(numbered, shared, True).select("row", "hit_words", "hit_items")))
        shared.destroy()
    every = reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hit_words"))).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    # ranges in order of their begin: one that touches the last one's end goes on with it
    last = lambda done: F.element_at(done, -1)
    step = lambda done, x: F.when((F.size(done) > 0) & (F.get(last(done), F.lit(1)) >= x[0]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last(done)[0], F.greatest(last(done)[1], x[1]))))).otherwise(F.concat(done, F.array(x)))
    merged = every.select(F.col("row").alias("number"), F.aggregate("w", F.array().cast("array<array<bigint>>"), step).alias("hit_words"), "hit_items")
    # words are counted by a pass of its own, with no pattern
    nothing = rows.sparkSession.sparkContext.broadcast(Patterns([], window))
    counted = _searched(rows.select("text", F.struct("number", "row").alias("row")), nothing, False).select("row.number", "row.row", "n_words")
    none = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("hit_words", "array<array<bigint>>"), ("hit_items", "array<string>"))]
    return counted.join(merged, "number", "left").select("row", "n_words", *none)


def contamination_report(found: DataFrame) -> DataFrame:
    """Figures of `find_contamination` per document."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
