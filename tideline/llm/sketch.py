"""Parity sketches of sets: a lower bound of how many elements two sets differ in.

A sketch of m bits has at each place the parity of the elements that a hash deals to it. Each element that only one of
two sets holds turns one bit, so the sketches differ in no more bits than the sets in elements. Folding a sketch in half by
exclusive or gives the sketch of half the width, so sketches of all widths can be compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkernel import mix

_SALT = np.uint64(0x2545F4914F6CDD1D)
_SMALLEST = 64
#: Bytes of sketches that are compared in one step, about.
_STEP = 8 << 20


def sketches(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.Array:
    """The sketch of each row's set of hashes; its width is the power of two from twice the set's size on, at least 64."""
    width = np.maximum(_SMALLEST, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    width[size == 0] = 0
    base = np.cumsum(width) - width
    place = base[row] + (mix(h + _SALT) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    place, odd = np.unique(place, return_counts=True)
    bits = np.zeros(int(width.sum()), np.uint8)
    bits[place] = odd & 1
    packed = np.packbits(bits, bitorder="little")
    offsets = np.append(base, len(bits)) >> 3
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])


def close_pairs(size: np.ndarray, sketch: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (left[k], right[k]) of sets may have a similarity of `percent` / 100 or more, by their sizes and sketches."""
    a, b = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    fits = np.flatnonzero((100 * a >= percent * b) & (a > 0))
    if not len(fits):
        return fits
    used = np.unique(np.concatenate([left[fits], right[fits]]))
    length = np.zeros(len(size), np.int64)
    length[used] = [len(sketch[i]) for i in used]
    most = (size[left] + size[right]) * (100 - percent)
    found = []
    narrow = np.minimum(length[left], length[right])
    for n in np.unique(narrow[fits]):  # sets of similar sizes have widths that differ by a factor of two at most
        own = fits[narrow[fits] == n]
        sets = np.unique(np.concatenate([left[own], right[own]]))
        at = np.zeros(len(size), np.int64)
        at[sets] = np.arange(len(sets))
        folded = np.empty((len(sets), n), np.uint8)
        for k, i in enumerate(sets):
            folded[k] = np.bitwise_xor.reduce(np.frombuffer(sketch[i], np.uint8).reshape(-1, n), axis=0)
        folded = folded.view(np.uint64)
        step = max(1, _STEP // int(n))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            differ = np.bitwise_count(folded[at[left[part]]] ^ folded[at[right[part]]]).sum(1, dtype=np.int64)
            found.append(part[differ * (100 + percent) <= most[part]])
    return np.sort(np.concatenate(found))
