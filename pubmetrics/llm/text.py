"""Arrow text columns as numpy arrays: bytes, words, hashes and windows of a whole batch at once.

Texts are UTF-8 bytes plus offsets; a null text is an empty one. Words are runs of anything but
0x20 and 0x09-0x0D, so cutting bytes never cuts a code point.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
STEP = 0x9E3779B97F4A7C15 | 1


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and idle ones would keep what they once had."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` text bytes; a longer text is a piece of its own."""
    offsets = utf8(batch.column(column))[1]
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each [offsets[i], offsets[i + 1]); empty segments give 0."""
    sums = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        sums[some] = np.add.reduceat(values, offsets[some], axis=0, dtype=sums.dtype)
    return sums


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _place(n: np.ndarray) -> np.ndarray:
    return mixed((n + 1).astype(U64) * U64(STEP))


PLACES = _place(np.arange(64))
#: The first i bytes of a block of eight.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


class Blocks:
    """Spans of an array of small integers as blocks of eight bytes, the last one filled with zeros.

    ``stops[i] - counts[i]`` is the first block of span i; ``within`` the place of each block in its span.
    """

    def __init__(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = body.itemsize
        step = 8 // size
        padded = np.concatenate([body, np.zeros(step, body.dtype)])
        every = np.ndarray(len(body) + 1, "<u8", padded, strides=(size,))  # one from each place on
        self.lengths = ends - starts
        self.counts = -(-self.lengths // step)
        self.stops = np.cumsum(self.counts)
        n = int(self.stops[-1]) if len(self.stops) else 0
        self.within = np.arange(n) - np.repeat(self.stops - self.counts, self.counts)
        at = self.within * step
        left = np.repeat(self.lengths, self.counts) - at
        at += np.repeat(starts, self.counts)
        self.values = every[at] & FIRST_BYTES[np.minimum(left, step) * size]

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the spans, equal for equal contents.

        Every block is scrambled with its place, so no change of places cancels out, as it can in
        powers of one base. Different spans meet by chance only; where that would matter they are compared.
        """
        far = len(self.within) and int(self.within.max()) >= len(PLACES)
        total = np.zeros(len(self.values) + 1, U64)
        np.cumsum(mixed(self.values * U64(STEP) + (_place(self.within) if far else PLACES[self.within])), out=total[1:])
        return mixed(total[self.stops] - total[self.stops - self.counts] + self.lengths.astype(U64))

    def same(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether spans ``one[i]`` and ``two[i]`` have the same contents."""
        same = self.lengths[one] == self.lengths[two]
        some = np.flatnonzero(same)
        one, two = one[some], two[some]
        counts = self.counts[one]
        first = self.stops - self.counts
        odd = self.values[ranges(first[one], counts)] != self.values[ranges(first[two], counts)]
        if odd.any():
            same[some] = segment_sums(odd, np.concatenate([[0], np.cumsum(counts)])) == 0
        return same


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, equal for equal bytes wherever they stand (``Blocks.hashes``)."""
    return Blocks(body, starts, ends).hashes()


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more than texts)."""
    apart = SEPARATOR[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= apart[:-1]
    after[:-1] |= apart[1:]
    starts, ends = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the index of each text's first window; none cross texts."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    at = ranges(first[:-1], counts)
    total = np.zeros(len(at), U64)
    for j in range(k):
        total = total * U64(STEP) + hashes[at + j]
    return mixed(total), np.concatenate([[0], np.cumsum(counts)])


def text_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes salted with the index of their text, so that equal ones meet within a text only."""
    n = len(first) - 1
    return hashes ^ np.repeat(mixed(np.arange(1, n + 1, dtype=U64)), np.diff(first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    likely = np.zeros(1 << 16, bool)
    likely[twice >> U64(48)] = True
    found = likely[keys >> U64(48)]
    at = np.flatnonzero(found)
    found[at] = twice[np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)] == keys[at]
    return found


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def code_points(body: np.ndarray) -> np.ndarray:
    """1 at the first byte of each code point, else 0."""
    return (body & 0xC0 != 0x80).astype(np.int64)


def gram_bins(body: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash bin of the byte n-gram that starts at each byte; 2 ** bits where it would leave its text."""
    h = np.zeros(len(body), np.uint32)
    for j in range(min(n, len(body))):  # shorter bodies have no n-gram at all
        h[: len(body) - j] = h[: len(body) - j] * np.uint32(0x01000193) + body[j:] + np.uint32(1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bins = (h >> np.uint32(32 - bits)).astype(np.int32)
    for j in range(1, n):
        last = offsets[1:] - j
        bins[last[last >= offsets[:-1]]] = 1 << bits
    return bins
