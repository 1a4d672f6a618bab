"""Vectorised text helpers shared by the operators that run inside Arrow tasks.

Everything here works on the UTF-8 buffer of one Arrow string column, without
making Python strings: words are byte spans, and each word has a 64-bit hash
computed from prefix sums, so the cost is a few array passes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The separators of words: space and the bytes 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z only.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that one vectorised step works on, unless one text is longer.
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 4 * CHUNK_BYTES:  # one very long text must not keep its tables for good
        _powers.clear()
    return up, down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most so many bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of its first word for each row (n + 1)."""
    inside = ~SEPARATOR[buf]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the bytes stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(buf))
        symbol = _SYMBOLS[ASCII_LOWER] if lower else _SYMBOLS
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(symbol[buf] * up[: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words from each place of a row, and their bounds by row.

    A row with fewer than n words, but at least one, gives its whole sequence.
    """
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(grams)])
    if not len(words):
        return np.zeros(0, np.uint64), bounds
    with np.errstate(over="ignore"):
        k = len(words)
        acc = np.zeros(k, np.uint64)
        for j in range(min(n, k)):
            acc[: k - j] = mix(acc[: k - j] ^ (words[j:] + np.uint64(0x632BE59BD9B4E019 * (j + 1) & (1 << 64) - 1)))
        row = np.repeat(np.arange(len(counts)), grams)
        at = first[:-1][row] + np.arange(len(row)) - bounds[:-1][row]
        out = acc[at]
        for r in np.flatnonzero((counts > 0) & (counts < n)):  # short rows: their own words only
            h = np.zeros(1, np.uint64)
            for j, w in enumerate(words[first[r] : first[r + 1]]):
                h = mix(h ^ (w + np.uint64(0x632BE59BD9B4E019 * (j + 1) & (1 << 64) - 1)))
            out[bounds[r]] = mix(h + np.uint64(counts[r]))[0]
    return out, bounds


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted, and the new bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(r[keep], minlength=len(bounds) - 1))])


#: Words in a shingle.
SHINGLE = 5


def shingles_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of each row in order (A-Z lower-cased), and their bounds."""
    starts, ends, first = word_spans(buf, offsets)
    return gram_hashes(span_hashes(buf, starts, ends), first, SHINGLE)


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd factors, one for each hash function on values that are scrambled already."""
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, cuts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over each stretch between cuts (none is empty): (n, functions)."""
    out = np.empty((len(cuts), len(factors)), np.uint64)
    with np.errstate(over="ignore"):
        for j, f in enumerate(factors):
            out[:, j] = np.minimum.reduceat(values * f, cuts)
    return out


class HashIndex:
    """64-bit keys to consecutive numbers, looked up for whole arrays at once (linear probing)."""

    def __init__(self, bits: int = 16):
        self._alloc(bits)
        self.n = 0

    def _alloc(self, bits: int) -> None:
        self.bits, self.mask = bits, np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        out = np.full(len(h), -1, np.int32)
        slot = h & self.mask
        v, k = self.vals[slot], self.keys[slot]
        hit = (v >= 0) & (k == h)
        out[hit] = v[hit]
        left = np.flatnonzero((v >= 0) & ~hit)
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            s = slot[left]
            v, k = self.vals[s], self.keys[s]
            hit = (v >= 0) & (k == h[left])
            out[left[hit]] = v[hit]
            left = left[(v >= 0) & ~hit]
        return out

    def _put(self, h: np.ndarray, v: np.ndarray) -> None:
        slot, left = h & self.mask, np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.vals[s] < 0
            self.vals[s[free]], self.keys[s[free]] = v[left[free]], h[left[free]]
            lost = ~free | (self.keys[s] != h[left])
            left = left[lost]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def add(self, h: np.ndarray) -> np.ndarray:
        """Numbers for new, distinct keys; they follow each other in the order given."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old, vals = self.keys[self.vals >= 0], self.vals[self.vals >= 0]
            self._alloc(int(np.ceil(np.log2(4 * (self.n + len(h)) + 2))))
            self._put(old, vals)
        v = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(h, v)
        self.n += len(h)
        return v


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


class Ragged:
    """Rows of numbers of various lengths, one after another; grows by doubling."""

    def __init__(self, kind):
        self._flat, self._at, self._size, self.used, self.n = np.zeros(1 << 14, kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    flat = property(lambda self: self._flat[: self.used])
    at = property(lambda self: self._at[: self.n])
    size = property(lambda self: self._size[: self.n])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self._flat = self._room(self._flat, self.used, self.used + len(flat))
        self._at, self._size = (self._room(x, self.n, self.n + len(sizes)) for x in (self._at, self._size))
        self._flat[self.used : self.used + len(flat)] = flat
        self._at[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self._size[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def with_more(self, flat: np.ndarray, sizes: np.ndarray) -> "Ragged":
        """A copy with these rows behind its own."""
        out = Ragged(self._flat.dtype)
        out.add(self.flat, self.size)
        out.add(flat, sizes)
        return out

    @staticmethod
    def _room(a: np.ndarray, used: int, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, 2 * len(a)), a.dtype)
        out[:used] = a[:used]
        return out
