"""Token ids of whole documents in Parquet list columns, in ascending order of id.

Documents are dealt to ranges of ids (`repartitionByRange`) and sorted there, then encoded in that order, so each task writes
one part and knows how many tokens stand before a document in it. Spark's own writer makes the files and commits them, so lost tasks are
run again as with any write. A table of parts, from the metadata columns alone, says where each part begins in the whole.

Ids are a list column, by a dictionary or as deltas; the columns beside it are deltas. Row groups and pages are kept small
enough that their statistics and the page index let a reader of a range of ids skip what it does not need, and readers of
metadata never touch the ids.

White space separates words for this vocabulary and is dropped, and its words never hold both letters and marks like a comma, so a text is
encoded by words that are cut there: each distinct one is given to the tokenizer once, and kept, while ids are put together with array
operations. Words of letters are given to it many at a time, as its ids say where a word ends. Texts of any length go through in pieces.

Defined results: null counts as empty; an empty text is the end id alone; rows with a null id come first; rows of one id are ordered by a hash
of their texts, and equal rows follow each other in any order; an empty table has no parts; other columns are left alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width
from .textkernel import CHUNK_BYTES, SPACE_SEPARATORS, chunks

#: Bytes of a vocabulary file, at most.
VOCABULARY_BYTES = 32 << 20
#: Words that a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST_WORD = 600_000, 48
#: Words that are given to the tokenizer as one text.
TOGETHER = 4_096
#: Bytes of text in a part, about; bytes of a row group and of a page.
PART_BYTES, GROUP_BYTES, PAGE_BYTES = 256 << 20, 32 << 20, 128 << 10
ENCODINGS = ("dictionary", "delta")


class WordEncoder:
    """Ids of many words at once by a tokenizer for which white space only separates words."""

    def __init__(self, vocabulary: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        ids = self.tokenizer.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for t, i in ids.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids of each)."""
        found: list[np.ndarray] = [np.zeros(0, np.int32)]
        n = np.zeros(len(words), np.int64)
        plain = [w.isalpha() for w in words]
        order = np.argsort(~np.array(plain, bool), kind="stable")
        letters = sum(plain)
        for lo in range(0, letters, TOGETHER):
            own = order[lo : min(lo + TOGETHER, letters)]
            ids = self._each([" ".join(words[i] for i in own)])[0]
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(own):
                n[own] = np.diff(last, prepend=-1)
                found.append(ids)
            else:  # some letter is more than a letter to the tokenizer
                each = self._each([words[i] for i in own])
                n[own] = [len(x) for x in each]
                found += each
        each = self._each([words[i] for i in order[letters:]])
        n[order[letters:]] = [len(x) for x in each]
        ids, sizes = np.concatenate(found + each), n[order]
        # back from that order to the given one
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sizes) - sizes
        return ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of a string array."""
        coded = words.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.lengths) + len(distinct) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        # of ASCII alone, and no special token: capitals make no difference to the vocabulary
        distinct = [w.lower() if w.isascii() and "<" not in w else w for w in distinct]
        known = self.slots
        slots = np.array([known.get(w, -1) for w in distinct], np.int64)
        ids, lengths = self.ids, self.lengths
        if len(fresh := np.flatnonzero(slots < 0)):
            words = [distinct[i] for i in fresh]
            more, n = self.encode(words)
            slots[fresh] = len(lengths) + np.arange(len(words))
            ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, n])
            # slots are given to long words too, but no later batch finds those
            known.update((w, k) for w, k in zip(words, slots[fresh].tolist(), strict=True) if len(w) <= LONGEST_WORD)
            self.ids, self.lengths = ids, lengths
        slot = slots[code]
        n = lengths[slot]
        first = (np.cumsum(lengths) - lengths)[slot]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return ids[at], n


@lru_cache(2)
def word_encoder(vocabulary: bytes) -> WordEncoder:
    return WordEncoder(vocabulary)


def _cuts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows): each row's text, and pieces of long ones, which begin at white space."""
    starts, rows = [], []
    for i in np.flatnonzero(end - begin > CHUNK_BYTES):
        lo = begin[i] + CHUNK_BYTES
        while lo < end[i]:
            gap = np.flatnonzero(SPACE_SEPARATORS[data[lo : min(lo + CHUNK_BYTES, end[i])]])
            if len(gap):
                starts.append(lo + gap[0])
                rows.append(i)
                lo = starts[-1]
            lo += CHUNK_BYTES
    starts, rows = np.concatenate([begin, np.array(starts, np.int64)]), np.concatenate([np.arange(len(begin)), np.array(rows, np.int64)])
    order = np.lexsort((starts, rows))
    return starts[order], rows[order]


#: Marks that no word holds beside letters, and that no combining mark changes; bytes that end and begin a letter below U+0180.
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?()")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def _cut_within(data: np.ndarray) -> np.ndarray:
    """Where a letter meets a mark, or a mark a letter: whether a word may be cut before each byte."""
    mark, letter = MARKS[data], LETTERS[data]
    lead = (data >= 0xC3) & (data <= 0xC5)
    first, second = data[:-1], data[1:]
    # two bytes, but for the signs of times and division, and the I with a dot, which becomes two characters in lower case
    wide = lead[:-1] & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) & ~((first == 0xC4) & (second == 0xB0))
    ends = letter.copy()
    ends[1:] |= wide
    begins = letter
    begins[:-1] |= wide
    cut = np.zeros(len(data), bool)
    cut[1:] = (ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
    return cut


def _piece_ids(encoder: WordEncoder, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number in each row) of rows that lie end to end in `data` from `begin` on."""
    word = ~SPACE_SEPARATORS[data]
    opens = np.empty(len(data), bool)
    opens[:1], opens[1:] = True, ~word[:-1]
    opens[begin[begin < len(data)]] = True
    opens |= _cut_within(data)
    opens &= word
    body = data[word]
    offsets = np.append(np.flatnonzero(opens[word]), len(body)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body))
    ids, n = encoder.of(words)
    upto = np.concatenate([[0], np.cumsum(n)])
    first = np.append(np.searchsorted(np.flatnonzero(opens), begin, side="left"), len(n))
    return ids, np.diff(upto[first])


def text_ids(encoder: WordEncoder, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids with the end id behind each text, number of each) for runs of rows of bounded size."""
    for chunk in chunks(column):
        if len(chunk.begin) > 1 or len(chunk.data) <= CHUNK_BYTES:
            ids, n = _piece_ids(encoder, chunk.data, chunk.begin)
        else:  # one long text, by pieces
            starts, _ = _cuts(chunk.data, chunk.begin, chunk.end)
            parts = [_piece_ids(encoder, chunk.data[a:b], np.zeros(1, np.int64))[0] for a, b in zip(starts, np.append(starts[1:], len(chunk.data)), strict=True)]
            ids, n = np.concatenate(parts), np.array([sum(map(len, parts))])
        yield chunk.lo, chunk.hi, np.insert(ids, np.cumsum(n), np.int32(end_id)), n + 1


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: bytes, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, part, before = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi, ids, n in text_ids(encoder, batch.column(1), end_id):
            upto = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + upto[:-1]), pa.array(n), lists], names=["doc_id", "part", "begin", "n_tokens", "ids"])
            before += int(upto[-1])


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file's bytes, which are sent to the tasks, so their number is checked."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary has {len(data)} bytes; at most {VOCABULARY_BYTES} are sent to tasks")
    return data


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, encoding: str = "dictionary", parts: int | None = None, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, text: str = "text") -> None:
    """Write (doc_id, part, begin, n_tokens, ids) of all documents below `path`/docs, and the table of parts to `path`/parts.

    `begin` counts the ids before a document in its part. `vocabulary` is a file of the `tokenizers` library whose words end at white
    space. Without `parts`, their number follows the bytes of text."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(shuffle_width(spark), -(-size // PART_BYTES))
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary))
    # equal rows can be told apart by where they were read, so a hot one is dealt to several parts
    keyed = own.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    keys = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row")]
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    encoded = dealt.mapInArrow(lambda it: _encoded(it, shared.value, end_id), f"doc_id {kind}, part int, begin bigint, n_tokens bigint, ids array<int>")
    # sizes are looked at every few rows, as a row is a whole document
    options = {"compression": "zstd", "parquet.block.size": group_bytes, "parquet.page.size": page_bytes, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower()}
    encoded.write.options(**options).parquet(f"{path}/docs")
    own_part = spark.read.parquet(f"{path}/docs").groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    own_part.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def read_metadata(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens), and ids if wanted: `start` counts the ids of all documents before. Ids are read only if asked for."""
    docs, parts = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/parts")
    both = docs.join(parts.select("part", F.col("start").alias("base")), "part")
    return both.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of documents from id `low` to `high`: the filter goes to the files, whose statistics and page index skip the rest."""
    return spark.read.parquet(f"{path}/docs").where(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids): the ids at places `start` to `stop` (exclusive) of the whole, by document; only parts that have some are looked at."""
    parts = spark.read.parquet(f"{path}/parts").where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    docs = spark.read.parquet(f"{path}/docs").join(parts.select("part", F.col("start").alias("base")), "part").withColumn("at", F.col("base") + F.col("begin"))
    low = F.greatest(F.lit(start) - F.col("at"), F.lit(0)).cast("int")
    high = F.least(F.lit(stop) - F.col("at"), F.col("n_tokens")).cast("int")
    found = docs.where((F.col("at") < stop) & (F.col("at") + F.col("n_tokens") > start))
    return found.select("doc_id", (F.col("at") + low).alias("start"), F.slice("ids", low + 1, high - low).alias("ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        ids = batch.column(3)
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ids are counted and summed as they are read."""
    stored = read_metadata(spark, path, ids=True)
    return stored.mapInArrow(_checksums, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")
