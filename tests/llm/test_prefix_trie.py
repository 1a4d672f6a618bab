"""The prefix trie against a plain one, built from the rebuilt texts."""

import hashlib
import random
import re
import zlib
from math import fmod

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, block string"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    words = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t) if w])
    saved = {p: (len(m) - 1) * words(p[-1][1]) if p else 0 for p, m in members.items()}
    inner = {p[:-1] for p in members if p}
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below), sum(saved[q] for q in below), digest)
    return out


def trie(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = pt.prefix_trie(df).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): tuple(r)[2:8] for r in got}


def conversations(seed, n=90):
    rnd = random.Random(seed)
    texts = ["hello there", "", None, "a b\tc", " x ", "one two three four", "é\x0bü 😀"]
    rows = []
    for c in rnd.sample(range(-45, 200), n):
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 7])):
            rows.append((c, rnd.choice([turn, turn, None]), rnd.choice(["user", "assistant", None]), rnd.choice(texts[: 3 + seed]), 1, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 3])
def test_trie_equals_a_plain_one(spark, monkeypatch, seed):
    """Ties, nulls, repeated rows, a null conversation, missing bases, and small pieces and blocks."""
    monkeypatch.setattr(pt, "PIECE_BYTES", 60)
    monkeypatch.setattr(pt, "BLOCK_TURNS", 4)
    rows = conversations(seed)
    rows += rows[:20] + [(None, 0, "user", "lost", 1, "x"), (60, None, None, None, None, None)]
    assert trie(spark, rows) == plain(rows)


def test_one_conversation_with_most_turns(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_TURNS", 100)
    rows = [(40, k, "user", f"w{k % 3} a", 1, "x") for k in range(700)] + [(c, k, "user", f"w{k % 3} a", 1, "x") for c in (41, 44, 47, 60) for k in range(5)]
    assert trie(spark, rows) == plain(rows)
    rows = [(c, k, "user", "same", 1, "x") for c in range(150) for k in range(2)]
    assert trie(spark, rows) == plain(rows)


def test_empty_and_turnless(spark):
    assert trie(spark, []) == {}
    assert trie(spark, [(None, 1, "a", "b", 1, "x")]) == {}
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, k, "user", "gone", 1, "x") for k in range(3)]
    assert trie(spark, rows) == plain(rows) and list(trie(spark, rows)) == [(turnless, 0)]


def test_products_compose():
    rnd, bases = random.Random(2), pt.Bases(0)
    leaf = [[rnd.randrange(p) for p in pt.PRIMES] for _ in range(9)]

    def whole(seq):
        return len(seq), [sum(t[k] * pow(bases.bases[k], i + 1, p) for i, t in enumerate(seq)) % p for k, p in enumerate(pt.PRIMES)]

    for cut in range(10):
        assert pt.compose(bases, whole(leaf[:cut]), whole(leaf[cut:])) == whole(leaf)
    big = np.array([0, 1, 65_535, 65_536, 3 * 10**9, 2**40 + 7])
    assert bases.power(big).tolist() == [[pow(b, int(n), p) for b, p in zip(bases.bases, pt.PRIMES)] for n in big]
    assert all(pow(p, 1) and all(p % d for d in range(2, 46_342)) for p in pt.PRIMES)


def test_equal_fingerprints_of_different_turns_are_found(spark, monkeypatch):
    """Under the first seed all turns get one class, or one fingerprint: both are noticed and made anew."""
    real, rows = pt.stored_turns, conversations(2, 30)

    def one_class(turns, seed, *names):
        out = real(turns, seed, *names)
        return out if seed else out.withColumns({"c1": F.lit(5).cast("long"), "c2": F.lit(5).cast("long")})

    monkeypatch.setattr(pt, "stored_turns", one_class)
    assert trie(spark, rows) == plain(rows)

    class Zero(pt.Bases):
        def __init__(self, seed):
            super().__init__(seed)
            if not seed:
                self.bases = [p for p in pt.PRIMES]

        def inverse(self, n):
            return [1] * 4 if self.bases[0] == pt.PRIMES[0] else super().inverse(n)

    monkeypatch.setattr(pt, "stored_turns", real)
    monkeypatch.setattr(pt, "Bases", Zero)
    assert trie(spark, rows) == plain(rows)
    monkeypatch.setattr(pt, "stored_turns", lambda t, seed, *n: one_class(t, 0, *n))
    with pytest.raises(RuntimeError):
        trie(spark, rows)
