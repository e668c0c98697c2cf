"""Blocks of UTF-8 texts as numpy arrays: words, word hashes, shingles, byte-string hashes.

An Arrow column of texts is cut into blocks of whole texts of about `BLOCK` bytes (a longer text is
a block of its own), so the working arrays of a task stay small however many rows it reads.
Hashes of byte strings are differences of prefix sums of a polynomial over random 64-bit values per
byte, modulo 2**64, so the hash of any substring takes constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U64 = np.uint64

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least `size` of each."""
    global _powers, _inverses
    if len(_powers) < size:
        size = max(size, BLOCK + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, U64(_MULTIPLIER)), np.full(size, U64(_INVERSE))
            up[0] = down[0] = U64(1)
            _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) per block; starts has one entry more than the block has rows.

    A null text is empty.
    """
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], (offsets[first : end + 1] - offsets[first])
        first = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block: starts, ends, document of each, words per document."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.texts = data, len(starts) - 1
        white = _WHITE[data]
        first = np.empty(len(data) + 1, bool)
        if len(data):
            first[0], first[1:-1] = True, white[:-1]
            first[starts] = True
            begins = np.flatnonzero(first[:-1] & ~white)
            first[-1] = True
            follows = np.empty(len(data), bool)
            follows[-1], follows[:-1] = True, white[1:]
            inner = starts[1:-1]
            follows[inner[inner > 0] - 1] = True
            ends = np.flatnonzero(follows & ~white) + 1
        else:
            begins = ends = np.zeros(0, np.int64)
        self.begins, self.ends = begins, ends
        self.document = np.searchsorted(starts, begins, "right") - 1
        self.bounds = np.searchsorted(begins, starts)
        self.counts = np.diff(self.bounds)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash of each word, A-Z folded if `lower`."""
        return hash_spans(prefix_sums(self.data, lower), self.begins, self.ends)

    def shingles(self, width: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): the `width`-word shingles of each text; with fewer words the whole sequence is one."""
        words = self.hashes(lower)
        with np.errstate(over="ignore"):
            windows = max(0, len(words) - width + 1)
            grams = np.zeros(windows, np.uint64)
            for i in range(width):
                grams += mix(words[i : windows + i] + U64(i)) * U64(pow(_MULTIPLIER, i + 1, 1 << 64))
            grams = mix(grams)
        per_text = np.where(self.counts >= width, self.counts - width + 1, np.minimum(self.counts, 1))
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        out = np.empty(bounds[-1], np.uint64)
        long = np.repeat(self.counts >= width, per_text)
        at = np.arange(len(out)) - np.repeat(bounds[:-1], per_text) + np.repeat(self.bounds[:-1], per_text)
        out[long] = grams[at[long]]
        for text in np.flatnonzero((self.counts > 0) & (self.counts < width)):
            low, high = self.bounds[text], self.bounds[text + 1]
            value = U64(high - low)
            with np.errstate(over="ignore"):
                for word in words[low:high]:
                    value = mix(np.array([value * U64(_MULTIPLIER) + word], np.uint64))[0]
            out[bounds[text]] = value
        return out, bounds


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums whose differences give the hash of any substring (hash_spans)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER if lower else _BYTES)[data] * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def value_sums(values: np.ndarray) -> np.ndarray:
    """Like `prefix_sums` over 64-bit values instead of bytes."""
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values | U64(1)) * _power_tables(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def hash_spans(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; equal byte strings have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[begins]) * _power_tables(len(sums))[1][begins])
