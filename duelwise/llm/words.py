"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word's hash depends on its bytes alone, so tasks agree on it. It is 64 bits wide; callers
that speak of equal words or sets mean equal hashes of that width or twice that width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; one longer text is handled alone.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
SPACED = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))
ALNUM = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@dataclass
class Words:
    """Words of consecutive texts; those of text i are offsets[i]:offsets[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts. A null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def split_words(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, lower: bool = True
) -> Words:
    """Runs of the bytes that `kind` marks, after lower-casing A-Z."""
    if lower:
        data = lower_case(data)
    start, end = runs(data, offsets, kind)
    return Words(data, start, end, np.searchsorted(start, offsets), hash_runs(data, start, end))


def lower_case(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(LOWER.tobytes()), np.uint8)


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of the bytes that `kind` marks; none spans two texts."""
    size = len(data)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = np.frombuffer(data.tobytes().translate(kind.tobytes()), bool)
    at = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = at[::2], at[1::2]
    edges = offsets[(offsets > 0) & (offsets < size)]
    cut = np.unique(edges[inside[edges] & inside[edges + 1]])
    if len(cut):
        start, end = np.sort(np.append(start, cut)), np.sort(np.append(end, cut))
    return start, end


_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash than `hash_runs`, quicker for short runs: eight bytes at a time."""
    padded = np.zeros((len(data) // 8 + 3) * 8, np.uint8)
    padded[:len(data)] = data
    padded = padded.view("<u8")
    size = end - start

    def eight(rows, skip: int) -> np.ndarray:
        at = start[rows] + skip
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        high = (padded[word + 1] << np.uint64(1)) << (np.uint64(63) - bits)
        return ((padded[word] >> bits) | high) & _LOW[np.minimum(size[rows] - skip, 8)]

    out = mix(eight(slice(None), 0) ^ (size.astype(np.uint64) * np.uint64(_BASE)))
    skip, left = 8, np.flatnonzero(size > 8)
    while len(left):
        out[left] = mix(out[left] * np.uint64(_BASE) + eight(left, skip))
        skip += 8
        left = left[size[left] > skip]
    return out


def _powers(base: int, size: int) -> np.ndarray:
    """Powers modulo 2**64, from the first to the one before `size`."""
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=sums[1:])
    down = _powers(_INVERSE, len(data))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each run of `size` words of one text; place is that of its first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + words.hash[i:i + n]
    text = words.text
    place = np.flatnonzero(text[:n] == text[size - 1:])
    return mix(total[place]), place


def whole(words: Words, text: int) -> np.uint64:
    """One hash of all words of a text."""
    total = int(words.offsets[text + 1] - words.offsets[text])
    for h in words.hash[words.offsets[text]:words.offsets[text + 1]]:
        total = (total * _BASE + int(h)) & _MASK
    return mix(np.array([total], np.uint64))[0]
