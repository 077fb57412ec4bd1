"""Vectorised word and shingle hashing over whole texts (numpy only).

A batch of UTF-8 texts is one byte buffer plus offsets.  Words are maximal runs
of bytes outside ``[\\x20\\x09-\\x0D]``; those separators are ASCII, so cutting
the UTF-8 bytes cuts the text at the same places.  Hashes are polynomial sums
modulo 2**64 taken from prefix sums, then mixed, so a batch costs a fixed number
of passes whatever the window length is.

Null texts count as empty; an empty text has no words.  A text of any length is
handled, alone in its batch if need be (see ``chunks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes; any odd values would do.
BYTE_BASE, WORD_BASE, ALT_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that are hashed together; a little less than a power of two, so that tables of powers stay small.
CHUNK_BYTES = (1 << 20) - 1024


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(BYTE_BASE))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, which leaves UTF-8 intact."""
    return _LOWER[data]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(12, (n - 1).bit_length())
        forward, back = np.full(m, base, U), np.full(m, pow(base, -1, 1 << 64), U)
        forward[0] = back[0] = 1
        have = (np.multiply.accumulate(forward), np.multiply.accumulate(back))
        if m <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i, and the inverse powers: see ``between``."""
    forward, back = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * forward[: len(values)], out=sums[1:])
    return sums, back


def between(p: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end], for each pair of bounds."""
    return mix((p[0][end] - p[0][start]) * p[1][start] + (end - start).astype(U))


class Words:
    """The words of a batch: byte bounds, hashes, and each text's first word (``first``, one entry more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        bounds = offsets[(offsets > 0) & (offsets < len(data))]
        start = edge[:-1] & inside
        end = edge[1:].copy() & inside
        if len(data):
            start[0], end[-1] = inside[0], inside[-1]
            start[bounds] = inside[bounds]
            end[bounds - 1] = inside[bounds - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = between(prefix(_BYTE[data], BYTE_BASE), self.start, self.end)
        self.data, self.offsets = data, offsets


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each hash, hash) of all k-word shingles, sorted by row and hash, distinct in a row.

    A row of fewer words than k, but some, has its whole sequence as one shingle.
    """
    count = np.diff(words.first)
    each = np.maximum(count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), each)
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(words.first[:-1], each)
    last = np.minimum(at + k, words.first[1:][row])
    h = between(prefix(words.hash, WORD_BASE), at, last)
    ends = np.cumsum(each)
    for a, b in zip(ends - each, ends):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]
