"""Vectorised text primitives over Arrow string columns.

Words are found and hashed with whole-buffer numpy operations, so the cost is a few passes over the
bytes and no Python object is made per word. A word's hash is a polynomial in its bytes modulo 2**64,
read from one running sum, then mixed. Texts of any length are handled in pieces of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_cache: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _cache:
        _cache["up"] = _powers(_BASE, PIECE + 1)
        _cache["down"] = _powers(_INV, PIECE + 1)
    return _cache["up"], _cache["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: One odd constant for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)

IDENTITY = np.arange(256, dtype=np.uint8)
ASCII_LOWER = IDENTITY.copy()
ASCII_LOWER[65:91] += 32

#: Separators of words that are runs of anything but ASCII white space.
SPACE_SEPARATORS = np.zeros(256, bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of words made of ASCII letters, digits and all non-ASCII characters.
SYMBOL_SEPARATORS = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    SYMBOL_SEPARATORS[_lo : _hi + 1] = True
SYMBOL_SEPARATORS[65:91] = False


@dataclass
class Chunk:
    """Some rows of a batch: their bytes, and where each row's text begins and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


@dataclass
class Words:
    """Words of a chunk in order: first byte, byte after the last, hash, and the row (within the chunk)."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    #: words of row i are first[i]:first[i + 1]
    first: np.ndarray


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into runs of rows of about `max_bytes` together. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin, end = off[:-1], off[1:]
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        end = np.where(null, begin, end)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        base = off[lo]
        yield Chunk(lo, hi, raw[base : off[hi]], begin[lo:hi] - base, end[lo:hi] - base)
        lo = hi


def words(chunk: Chunk, separators: np.ndarray, fold: np.ndarray = IDENTITY) -> Words:
    """All words of a chunk with their hashes; a word never spans two rows."""
    up, down = _tables()
    n = len(chunk.data)
    is_begin = np.zeros(n + 1, bool)
    is_begin[chunk.begin] = True
    is_begin[chunk.end] = True
    starts, stops, hashes = [], [], []
    prev_sep = True
    for p in range(0, n, PIECE):
        b = fold[chunk.data[p : p + PIECE]]
        m = len(b)
        sep = separators[b]
        before = np.empty(m, bool)
        before[0] = prev_sep
        before[1:] = sep[:-1]
        opens = before | is_begin[p : p + m]
        prev_sep = bool(sep[-1])
        word = ~sep
        continued = p > 0 and bool(word[0]) and not opens[0]
        if continued:
            opens[0] = True
        s = np.flatnonzero(word & opens)
        after = np.empty(m, bool)
        after[:-1] = sep[1:] | is_begin[p + 1 : p + m]
        after[-1] = True
        e = np.flatnonzero(word & after) + 1
        run = np.empty(m + 1, np.uint64)
        run[0] = 0
        np.cumsum(BYTE_VALUES[b] * up[:m], out=run[1:])
        h = (run[e] - run[s]) * down[s]
        if continued:
            length = p + int(s[0]) - int(starts[-1][-1])
            joined = (int(hashes[-1][-1]) + pow(_BASE, length, 1 << 64) * int(h[0])) & _MASK
            hashes[-1][-1] = joined
            stops[-1][-1] = p + int(e[0])
            s, e, h = s[1:], e[1:], h[1:]
        if len(s) or not starts:
            starts.append(s + p)
            stops.append(e + p)
            hashes.append(h)
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none, np.zeros(len(chunk.begin) + 1, np.int64))
    start, stop, raw = np.concatenate(starts), np.concatenate(stops), np.concatenate(hashes)
    first = np.append(np.searchsorted(start, chunk.begin, side="left"), len(start))
    row = np.repeat(np.arange(len(chunk.begin)), np.diff(first))
    return Words(start, stop, mix(raw + (stop - start).astype(np.uint64)), row, first)


def ngram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all runs of `n` words; a row of fewer words, but not none, gives its whole sequence once."""
    total, counts = len(w.hash), np.diff(w.first)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = _powers(_BASE, n)
    if total >= n:
        acc = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            acc += w.hash[j : total - n + 1 + j] * mult[j]
        inside = w.row[: total - n + 1] == w.row[n - 1 :]
        h, row = mix(acc[inside]), w.row[: total - n + 1][inside]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            a, b = w.first[r], w.first[r + 1]
            own[i] = (w.hash[a:b] * mult[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        h, row = np.concatenate([h, mix(own)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row
