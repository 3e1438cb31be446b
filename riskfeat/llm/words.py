"""Words and word hashes of many texts at once, on the bytes of an Arrow column.

A slice of texts is one run of bytes.  A word's hash is a difference of prefix sums of byte * BASE^i
modulo 2^64, moved to a common power and mixed, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def give_back() -> None:
    """Return freed memory to the system.  Python workers stay for later stages, with all they have held, unless told so."""
    pa.default_memory_pool().release_unused()
    # Only the GNU C library has this.
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _room(n: int) -> int:
    return max(SLICE_BYTES, 1 << max(0, n - 1).bit_length()) + 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    ends = np.concatenate([[0], np.cumsum(byte_lengths(texts))])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets(texts))


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind) if texts.buffers()[1] else np.zeros(1, kind)
    return raw[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column without nulls; offsets start at 0."""
    at = _offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of a slice of texts: ``doc`` and ``start``/``end`` byte per word, in order, and ``hash``.

    ``is_word`` tells for each byte value whether it belongs to a word; A-Z count as a-z.  ``raw`` holds
    the slice's bytes as they are.
    """

    def __init__(self, texts: pa.Array, is_word: np.ndarray) -> None:
        raw, at = text_bytes(texts)
        self.raw = raw
        self.n_docs = len(texts)
        n = len(raw)
        inside = is_word[raw]
        # A word also begins where a text begins and ends where one ends.
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        full = at[1:] > at[:-1]
        first[at[:-1][full]] = True
        last[at[1:][full] - 1] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (first | ~before))
        self.end = np.flatnonzero(inside & (last | ~after)) + 1
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        #: Index of each text's first word; one entry more than texts.
        self.bounds = np.searchsorted(self.start, at)
        self._room = _room(n)
        values = np.where((raw >= 65) & (raw <= 90), raw + 33, raw + 1).astype(np.uint64)
        values *= _powers(BASE, self._room)[:n]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values, out=self._sums[1:])
        self.hash = self.hash_spans(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, A-Z lowered; equal strings have equal hashes."""
        h = (self._sums[end] - self._sums[start]) * _powers(BASE_INVERSE, self._room)[start]
        return mix(h ^ (end - start).astype(np.uint64))


def byte_class(*ranges: tuple[int, int], inverted: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return ~table if inverted else table


#: Runs of anything but blank, tab and the line ends.
NOT_BLANK = byte_class((0x20, 0x20), (0x09, 0x0D), inverted=True)
#: Runs of ASCII digits and letters (A-Z already lowered) and of everything beyond ASCII.
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F), inverted=True)
