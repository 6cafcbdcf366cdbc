"""Token counts of the sections of documents, by offset-mapped attribution.

A document is encoded once, whole. Byte-level tokens put end to end are the text's bytes, so the running sum of
their lengths gives each token's span; sections are byte spans as well. The interval join of the two is a binary
search of token borders among section borders, per document. A token that lies in several sections is
allocated by a rule: to the section of its first byte, of its last byte, to the one that holds most of it (the first
of equals), or to all of them by their share.

The vocabulary is read once by the driver from a path that the caller names, and its size is checked before it is sent
to the tasks.

Defined results: null counts as an empty text; an empty text has one empty section with 0 tokens; text that no section
covers is section -1; repeated rows each get their own rows, and a null id stays null. Other columns are not looked at. Of given
sections, one that overlaps an earlier one has what lies behind that; one without a start or a stop has no row. A text is
encoded in one task, whatever its length, in time that grows with its tokens and sections.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import chunks

# Fixed value: the published pattern that cuts a text before byte-pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a vocabulary file, at most.
VOCABULARY_BYTES = 32 << 20
RULES = ("first", "last", "most", "share")


@lru_cache(2)
def _encoder(data: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def token_ends(encoder, length: np.ndarray, text: str) -> np.ndarray:  # noqa: ANN001
    """Byte offset behind each token."""
    return np.cumsum(length[np.array(encoder.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)


def allocate(ends: np.ndarray, first: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of adjoining sections that begin at the offsets `first`; the last one is open-ended.

    crossing counts the tokens that begin in a section and end in a later one."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    a = np.searchsorted(first, starts, side="right") - 1
    b = np.searchsorted(first, ends - 1, side="right") - 1
    n = len(first)
    crossing = np.bincount(a[b > a], minlength=n)
    if rule == "first":
        return np.bincount(a, minlength=n), crossing
    if rule == "last":
        return np.bincount(b, minlength=n), crossing
    inner = a == b
    out = np.bincount(a[inner], minlength=n).astype(float)
    across = np.flatnonzero(~inner)
    if not len(across):
        return out, crossing
    # a row for each such token and section that it touches: at most the sections and as many again
    sizes = b[across] - a[across] + 1
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(across)), sizes)
    touched = np.arange(len(owner)) - begin[owner] + a[across][owner]
    upper = np.append(first[1:], ends[-1])[touched]
    part = np.minimum(upper, ends[across][owner]) - np.maximum(first[touched], starts[across][owner])
    if rule == "share":
        return out + np.bincount(touched, part / np.add.reduceat(part, begin)[owner], n), crossing
    largest = np.flatnonzero(part == np.maximum.reduceat(part, begin)[owner])
    earliest = largest[np.unique(owner[largest], return_index=True)[1]]
    return out + np.bincount(touched[earliest], minlength=n), crossing


def line_starts(data: np.ndarray) -> np.ndarray:
    """Sections are lines with their line feed; a line feed at the very end begins no line."""
    at = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], at[at < len(data)]])


def _section_rows(batches: Iterator[pa.RecordBatch], vocabulary: bytes, rule: str, given: bool) -> Iterator[pa.RecordBatch]:
    encoder, length = _encoder(vocabulary)
    for batch in batches:
        text = batch.column(1)
        for chunk in chunks(text):
            rows, names, lows, highs, counts, crossed = [], [], [], [], [], []
            for i in range(len(chunk.begin)):
                data = chunk.data[chunk.begin[i] : chunk.end[i]]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                if given:  # (start, stop) in code points; what lies between is section -1
                    spans = sorted((s["start"], s["stop"], k) for k, s in enumerate(batch.column(2)[chunk.lo + i].as_py() or []) if s and None not in (s["start"], s["stop"]))
                    to_byte = lambda c, chars=chars: max(0, int(np.searchsorted(chars, c, side="right")) - 1)
                    first, label = [0], [-1]
                    for s, e, k in spans:
                        low = max(to_byte(s), first[-1])
                        first += [low, max(to_byte(e), low)]
                        label += [k, -1]
                    first, label = np.array(first), np.array(label)
                    keep = np.append(first[1:] > first[:-1], first[-1] < len(data)) | (label >= 0)
                    keep[0] |= not keep.any()
                    first, label = first[keep], label[keep]
                else:
                    first = line_starts(data)
                    label = np.arange(len(first))
                n, crossing = allocate(token_ends(encoder, length, data.tobytes().decode("utf-8", "replace")), first, rule)
                rows.append(np.full(len(first), chunk.lo + i))
                names.append(label)
                lows.append(chars[first])
                highs.append(chars[np.append(first[1:], len(data))])
                counts.append(n)
                crossed.append(crossing)
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            kind = np.float64 if rule == "share" else np.int64
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(np.concatenate(x).astype(np.int64)) for x in (names, lows, highs)], pa.array(np.concatenate(counts).astype(kind)), pa.array(np.concatenate(crossed).astype(np.int64))],
                names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"],
            )


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "most", sections: str | None = None, text: str = "text") -> DataFrame:
    """Per section of each document: doc_id, section, start and stop (code points), n_tokens, and n_crossing, the tokens that begin in
    it and end in a later one. `sections` names a column of arrays of (start, stop); without it, sections are lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    size = docs.sparkSession.read.format("binaryFile").load(vocabulary).select("content").first().content
    if len(size) > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary has {len(size)} bytes; at most {VOCABULARY_BYTES} are sent to tasks")
    shared = docs.sparkSession.sparkContext.broadcast(bytes(size))
    own = docs.select("doc_id", F.col(text).alias("text"), *([sections] if sections else []))
    fields = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, section bigint, start bigint, stop bigint, n_tokens {'double' if rule == 'share' else 'bigint'}, n_crossing bigint"
    return own.mapInArrow(lambda it: _section_rows(it, shared.value, rule, sections is not None), fields)
