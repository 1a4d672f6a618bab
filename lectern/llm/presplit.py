"""Pre-splitting of whole text blocks for byte-pair encoders, by array passes over code points.

Two rules are offered. ``words``: contractions, letter runs, single digits and
runs of other signs; white space is dropped. ``spaced``: the same with digit
runs, one leading space belonging to the piece after it, and runs of white
space as pieces of their own. Texts with signs outside the table's range, or
with control strings of the tokenizer, are left to the caller.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from lectern.llm.textkit import HashIndex, Ragged, chunks, mix, powers, ragged, utf8

#: Code points of the tables; a text with any other one takes the caller's slow path.
KNOWN = 0x2E80
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(KNOWN, OTHER, np.uint8)
    fold = np.arange(KNOWN, dtype=np.uint32)
    plain = np.ones(KNOWN, bool)
    for name, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for m in regex.finditer(pattern, "".join(map(chr, range(KNOWN)))):
            kind[m.start()] = name
    for i in range(KNOWN):
        low = chr(i).lower()
        if len(low) == 1 and ord(low) < KNOWN:
            fold[i] = ord(low)
        else:
            plain[i] = False
        if unicodedata.category(chr(i)) == "Cn" or 0x1C <= i <= 0x1F or i == 0x85:
            plain[i] = False  # unassigned, or read differently by different libraries
    return kind, fold, plain


_KIND, _FOLD, _PLAIN = _tables()
_SYMBOL = np.random.default_rng(7).integers(1, 1 << 62, KNOWN, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_QUOTE = ord("'")
_ONE, _TWO = np.zeros(KNOWN, bool), np.zeros((3, KNOWN), bool)
_ONE[[ord(c) for c in "stmd"]] = True
_PAIRS = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


def blank(cp: np.ndarray) -> np.ndarray:
    """Which code points of the tables are white space."""
    return _KIND[cp] == SPACE


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _contractions(cp: np.ndarray, start: np.ndarray, opens: np.ndarray, row: np.ndarray, kind: np.ndarray) -> None:
    """Marks the pieces 's 't 'm 'd 're 've 'll that begin at ``opens``."""
    n = len(cp)
    for i in opens:
        if i + 1 >= n or row[i + 1] != row[i]:
            continue
        size = 2 if _ONE[cp[i + 1]] else 3 if i + 2 < n and row[i + 2] == row[i] and (cp[i + 1], cp[i + 2]) in _PAIRS else 0
        if size:
            start[i + 1 : i + size] = False
            if i + size < n and row[i + size] == row[i] and kind[i + size] == LETTER:
                start[i + size] = True


def split_words(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the rule ``words``."""
    kind = _KIND[cp]
    first = np.ones(len(cp), bool)
    first[1:] = row[1:] != row[:-1]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = (kind != SPACE) & (change | (kind == NUMBER))
    _contractions(cp, start, np.flatnonzero((cp == _QUOTE) & start), row, kind)
    last = np.ones(len(cp), bool)
    last[:-1] = first[1:] | (kind[1:] == SPACE) | start[1:]
    return np.flatnonzero(start), np.flatnonzero(last & (kind != SPACE)) + 1


def split_spaced(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the rule ``spaced``; they cover the text."""
    kind = _KIND[cp]
    n = len(cp)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    joins = np.zeros(n, bool)  # a sign after a plain space belongs to that space's piece
    joins[1:] = ~first[1:] & (kind[1:] != SPACE) & (cp[:-1] == 32)
    space_then_sign = np.zeros(n, bool)
    space_then_sign[:-1] = (kind[:-1] == SPACE) & ~first[1:] & (kind[1:] != SPACE)
    opens = np.flatnonzero((cp == _QUOTE) & start & ~joins)
    start = (start & ~joins) | space_then_sign
    _contractions(cp, start, opens, row, kind)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


class PieceEncoder:
    """Encodes texts through a cache of the pieces met so far, a whole block of texts at a time.

    ``new`` gets distinct pieces (their code points one after another, and n + 1
    offsets) and gives their ids one after another with the number of each;
    ``slow`` encodes one text that the tables don't cover. A piece is looked up by
    a hash and compared sign by sign, so that pieces of one hash are never mixed
    up. The cache is emptied beyond ``most`` pieces, so memory stays bounded.
    """

    def __init__(self, rule: Callable, fold: bool, new: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], slow: Callable[[str], np.ndarray], control: list[str], most: int = 600_000):
        self.rule, self.fold, self.new, self.slow, self.most = rule, fold, new, slow, most
        self.control = regex.compile("|".join(map(regex.escape, control)))
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.ids, self.signs = Ragged(np.int32), Ragged(np.uint16)

    def _numbers(self, h: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each piece in the cache; -1 where it is new, -2 where another piece has its hash."""
        number = self.index.find(h)
        hit = np.flatnonzero(number >= 0)
        known = number[hit]
        same = self.signs.size[known] == sizes[hit]
        hit, known = hit[same], known[same]
        equal = self.signs.flat[ragged(self.signs.at[known], sizes[hit])] == cp[ragged(starts[hit], sizes[hit])]
        good = np.logical_and.reduceat(equal, np.cumsum(sizes[hit]) - sizes[hit]) if len(hit) else np.zeros(0, bool)
        out = np.where(number >= 0, -2, -1)
        out[hit[good]] = known[good]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and n + 1 offsets."""
        if self.index.n > self.most:
            self.clear()
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        off = np.concatenate([[0], np.cumsum(lengths)])
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = (cp >= KNOWN) | ~_PLAIN[np.minimum(cp, KNOWN - 1)]
        slow = np.diff(np.concatenate([[0], np.cumsum(odd)])[off]) > 0
        if self.fold and not unicodedata.is_normalized("NFC", joined):
            slow |= np.array([not unicodedata.is_normalized("NFC", t) for t in texts])
        if self.control.search(joined):
            slow |= np.array([bool(self.control.search(t)) for t in texts])
        row = np.repeat(np.arange(len(texts)), lengths)
        if slow.any():
            cp, row = cp[~slow[row]], row[~slow[row]]
        if self.fold:
            cp = _FOLD[cp]
        starts, ends = self.rule(cp, row) if len(cp) else (np.zeros(0, np.int64),) * 2
        sizes = ends - starts
        with np.errstate(over="ignore"):
            up, down = powers(len(cp))
            sums = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(_SYMBOL[cp] * up[: len(cp)], out=sums[1:])
            h = mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.zeros(0, np.uint64)
        number = self._numbers(h, cp, starts, sizes)
        missing = np.flatnonzero(number == -1)
        if len(missing):
            fresh, place = np.unique(h[missing], return_index=True)
            first = missing[place]
            signs = cp[ragged(starts[first], sizes[first])]
            self.ids.add(*self.new(signs, np.concatenate([[0], np.cumsum(sizes[first])])))
            self.signs.add(signs, sizes[first])
            self.index.add(fresh)
            number[missing] = self._numbers(h[missing], cp, starts[missing], sizes[missing])
        clash = np.flatnonzero(number == -2)
        ids, number = self.ids, number.copy()
        if len(clash):  # these are encoded for this block only
            own, n = self.new(cp[ragged(starts[clash], sizes[clash])], np.concatenate([[0], np.cumsum(sizes[clash])]))
            number[clash] = len(ids.size) + np.arange(len(clash))
            ids = ids.with_more(own, n)
        size = ids.size[number]
        flat = ids.flat[ragged(ids.at[number], size)]
        counts = np.bincount(row[starts], weights=size, minlength=len(texts)).astype(np.int64) if len(starts) else np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if not slow.any():
            return flat, bounds
        parts = [np.asarray(self.slow(t), np.int32) if slow[i] else flat[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode_column(self, column: pa.Array, most: int = 500_000):
        """(first row, ids, offsets) for ranges of a column's rows of at most so many bytes, or one row; null is empty."""
        _, off = utf8(column)
        for lo, hi in chunks(off, most):
            yield (lo, *self.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()]))
