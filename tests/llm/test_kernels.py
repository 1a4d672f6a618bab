"""Array kernels against plain versions; no Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import bpe_automaton as bpe
from lectern.llm import exchange
from lectern.llm import pitman_yor as py
from lectern.llm import png_media as png
from lectern.llm import presplit, rans_tokens
from lectern.llm import substring_dedup as sd
from lectern.llm import textkit as tk

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PIECES = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "é", "É", "Ⅷ", "1", "23", "a", "b", "th", "ing", "the", "-", "..", "!?", "<|endoftext|>", "Σ", "İ", "ß", "日本", "é", " ", "\x1c", "\x0b", "​", "😀", "aaaa", "'S", "x'", " '", "\n's", "\r\n"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_words_are_those_of_the_rule():
    import re

    col = pa.array(["a  b\x0bc", None, "", " x ", "é z\x1fy A"])
    buf, off = tk.utf8(col)
    starts, ends, first = tk.word_spans(buf, off)
    got = [[bytes(buf[starts[k] : ends[k]]).decode() for k in range(first[i], first[i + 1])] for i in range(5)]
    assert got == [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in col.to_pylist()]
    h = tk.span_hashes(buf, starts, ends)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1  # a and A, all others differ


def test_shingles_of_short_rows():
    buf, off = tk.utf8(pa.array(["a b", "a b", "a b c d e", "a b c d e f", "", "a"]))
    h, b = tk.shingles_of(buf, off)
    assert np.diff(b).tolist() == [1, 1, 1, 2, 0, 1] and h[0] == h[1] and h[2] == h[3]


def test_hash_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 200_000).astype(np.uint64))
    index = tk.HashIndex(4)
    for part in np.array_split(keys, 7):
        assert (index.find(part) < 0).all()
        index.add(part)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1 << 63)) < 0).all()


def test_automaton_equals_the_library():
    path = public.path("word_bpe_49k.json")
    mine, lib = bpe.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    t = texts(3000, 3) + [f"a{chr(c)}b1" for c in range(0, presplit.KNOWN, 3)]
    ids, off = mine.encoder.encode(t)
    want = [e.ids for e in lib.encode_batch(t, add_special_tokens=False)]
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(t))] == want
    for w in want[:500]:
        assert b" ".join(mine.labels[i] for i in w).decode() == lib.decode(w, skip_special_tokens=False)


def test_small_automaton_keeps_leftmost_merges():
    vocab = {c: i for i, c in enumerate(["a", "b", "aa", "ab", "aab", "aaaa"])}
    vocab |= {c: 100 + i for i, c in enumerate(bpe.byte_letters()) if c not in vocab}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("aa", "aa")]
    auto = bpe.TokenizationAutomaton(vocab, merges)

    def plain(word):
        seq = list(word)
        while True:
            ranks = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(seq, seq[1:])) if (x, y) in merges]
            if not ranks:
                return [vocab[x] for x in seq]
            _, i = min(ranks)
            seq[i : i + 2] = ["".join(seq[i : i + 2])]

    rng = random.Random(1)
    for n in range(500):
        if n == 250:
            auto.most_arcs = len(auto.table)  # from now on the added arcs go again and again
        w = "".join(rng.choice("aab") for _ in range(rng.randint(1, 12)))
        assert auto.encode_word(w.encode()) == plain(w)


def test_byte_encoder_equals_the_library():
    path = public.path("byte_bpe_50k.json")
    mine, lib = rans_tokens.ByteTokenizer(path), tokenizers.Tokenizer.from_file(path)
    t = texts(3000, 5) + [f" {chr(c)} 1" for c in range(0, presplit.KNOWN, 3)]
    ids, off = mine.encoder.encode(t)
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(t))] == [e.ids for e in lib.encode_batch(t, add_special_tokens=False)]


def test_segments_round_trip_and_find_damage():
    ids = (np.random.default_rng(1).zipf(1.3, 80_000) % 50_000).astype(np.int32)
    for n in (0, 1, 31, 33, rans_tokens.BLOCK, 80_000):
        parts = (np.array([7, -3]), np.array([True, False]), np.array([n // 2, n - n // 2]), ids[:n])
        body = rans_tokens.pack_segment(*parts)
        assert all((a == b).all() for a, b in zip(parts, rans_tokens.unpack_segment(body)))
    for at in (3, 60, len(body) // 2, len(body) - 2):
        with pytest.raises(Exception):
            rans_tokens.unpack_segment(body[:at] + bytes([body[at] ^ 1]) + body[at + 1 :])


def test_png_round_trip_filters_and_checksums():
    rng = random.Random(2)
    for n in (1, 2, 31, 40, 300):
        payload = bytes(rng.choice(b"abc \0\xff") for _ in range(64 * n))
        data = png.png_of(payload)
        assert png.image_of(data).tobytes() == payload
        with pytest.raises(ValueError):
            png.image_of(data[:20] + b"\x01" + data[21:])
    rows = np.array([[k, *rng.choices(range(256), k=6)] for k in (3, 4, 0, 2, 2, 1, 4, 3)], np.uint8)
    want = np.zeros((8, 6), int)
    for r, line in enumerate(rows):
        for i, v in enumerate(line[1:]):
            w, n, nw = (want[r, i - 1] if i else 0), (want[r - 1, i] if r else 0), (want[r - 1, i - 1] if r and i else 0)
            paeth = min((w, n, nw), key=lambda x: abs(w + n - nw - x))
            want[r, i] = (int(v) + [0, w, n, (w + n) // 2, paeth][line[0]]) & 255
    assert (png._unfilter(rows) == want).all()


def test_index_intervals_hold_all_equal_windows():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 3_000)
    text[1_000:1_060] = text[200:260]
    text[-1] = 0  # a text ends with the separator
    index = sd.FMIndex(text, 4)
    count = {}
    for p in range(len(text) - sd.LENGTH + 1):
        count[tuple(text[p : p + sd.LENGTH])] = count.get(tuple(text[p : p + sd.LENGTH]), 0) + 1
    seen = 0
    for t, which, low, high in index.matching(text, np.array([1_060, 500]), np.array([60, 40])):
        for w, a, b in zip(which, low, high):
            p = [1_060, 500][w] - t
            assert b - a == count[tuple(text[p : p + sd.LENGTH])]
            assert all((text[s : s + sd.LENGTH] == text[p : p + sd.LENGTH]).all() for s in index.order[a:b])
            seen += 1
    assert seen == 41 + 21


def test_wavelet_ranks():
    seq = np.random.default_rng(3).integers(0, 37, 1_000)
    w = sd.WaveletMatrix(seq, 37)
    at = np.arange(0, 1_001, 50)
    for s in range(37):
        assert (w.rank(np.full(len(at), s), at) == [(seq[:i] == s).sum() for i in at]).all()


def exact_tables(c, a, d):
    """Probabilities of 1, 2, ... tables of ``c`` customers: S(c, t) a^t, by the recurrence of the Stirling numbers."""
    row = np.zeros(c + 2)
    row[1] = 1.0
    t = np.arange(1, c + 1)
    for n in range(1, c):
        new = np.zeros_like(row)
        new[1 : c + 1] = row[:c] + (n - d * t) * row[1 : c + 1]
        row = new / new.max()
    with np.errstate(divide="ignore"):
        log = np.log(row[1 : c + 1]) + t * np.log(a)
    p = np.exp(log - log.max())
    return p / p.sum()


class Constant(py.Parent):
    """A parent whose chance doesn't change with its customers."""

    def __getitem__(self, rows):
        return self

    def chance(self, k):
        return np.full(k.shape if k.ndim > 1 else (1, len(k)), self.back)


@pytest.mark.parametrize("c,a,d", [(3, 0.7, 0.6), (6, 1.0, 0.7), (12, 1.0, 0.7), (60, 3.0, 0.7), (200, 1.0, 0.7), (200, 3.0, 0.7), (2_000, 4.0, 0.5), (5_000, 6.0, 0.8), (1_000, 100.0, 0.7), (2_048, 100.0, 0.7)])
def test_seating_has_the_right_distribution(c, a, d):
    """Mean within 2 %, and the whole distribution, for dishes of few and of many customers."""
    n, others = (40_000 if a < 50 else 4_000), 1e9
    h = tk.mix(np.arange(n, dtype=np.uint64))
    parent = Constant(None, None, a / (1 + d * others), None, 0.0)
    t = py.seat(np.full(n, c), np.full(n, others), parent, d, h, 1)
    want = exact_tables(c, a, d)
    assert abs(t.mean() / (want * np.arange(1, c + 1)).sum() - 1) < 0.02
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - want).max() < 0.02


def test_seating_of_thousands_of_tables():
    """The normal form beyond 2,048 tables against the mean of a Chinese restaurant, whose customers are all of one dish."""
    c, d, theta, rng = 60_000, 0.9, 2_000.0, np.random.default_rng(1)
    others, sizes = (theta - 1) / d, []
    for _ in range(20):
        t, u = 1, rng.random(c)
        for i in range(1, c):
            t += u[i] * (i + theta) < theta + d * t
        sizes.append(t)
    sure = Constant(None, None, 1.0, None, 0.0)
    got = py.seat(np.full(20, c), np.full(20, others), sure, d, tk.mix(np.arange(20, dtype=np.uint64)), 1)
    assert abs(got.mean() / np.mean(sizes) - 1) < 0.02 and got.std() < 3 * np.std(sizes)


def test_seating_takes_the_parent_along():
    """Three customers of a dish that the parent has nowhere else: a second table finds the first one's customer there."""
    d, e, n, others, back, whole = 0.5, 0.4, 100_000, 2.0, 0.3, 5.0
    t = py.seat(np.full(n, 3), np.full(n, others), py.Parent(np.zeros(n), np.zeros(n, bool), np.full(n, back), np.full(n, whole), e), d, tk.mix(np.arange(n, dtype=np.uint64)), 2)
    more = [(1 + d * (others + k)) * (k - e + back) / (whole + k) for k in (1, 2)]
    w = np.array([(1 - d) * (2 - d), 3 * (1 - d) * more[0], more[0] * more[1]])
    assert np.abs(np.bincount(t, minlength=4)[1:] / n - w / w.sum()).max() < 0.01


def test_seating_is_the_same_for_all_holders():
    c = np.array([2, 5, 40, 700, 3, 1, 0, 90_000])
    n = len(c)
    h = tk.mix(np.arange(n, dtype=np.uint64))
    parent = py.Parent(np.full(n, 2.0), np.ones(n, bool), np.full(n, 0.1), np.full(n, 30.0), 0.5)
    both = py.seat(c, np.arange(n) * 3, parent, 0.7, h, 4)
    alone = [py.seat(c[[i]], np.array([3 * i]), parent[[i]], 0.7, h[[i]], 4)[0] for i in range(n)]
    assert (both == alone).all() and (both >= np.minimum(c, 1)).all() and (both <= c).all()


def test_planes():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 1_000).astype(np.uint64))
    assert (py._from_planes(py._planes(v)) == v).all()


def test_payloads():
    parts = (np.arange(5, dtype=np.uint64), b"raw \0", np.zeros(0, np.int32), np.array([True, False]))
    back = exchange.unpack(exchange.pack(*parts))
    assert back[1] == parts[1] and all(x.dtype == y.dtype and (x == y).all() for i, (x, y) in enumerate(zip(parts, back)) if i != 1)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """All pieces get one of four hashes; the ids are those of the library nevertheless."""
    path = public.path("byte_bpe_50k.json")
    mine, lib = rans_tokens.ByteTokenizer(path), tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(presplit, "mix", lambda h: tk.mix(h) & np.uint64(3))
    t = texts(300, 8)
    for part in (t[:100], t[100:], t):
        ids, off = mine.encoder.encode(part)
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(part))] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
