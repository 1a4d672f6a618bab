"""Families of more than one block: what is compared, how often a text is read, and the same components."""

import random

import pytest
from test_operators import brute_components

from lectern.llm import near_dedup


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"e{rng.randrange(10**9)}"
    return words


def read_rows(monkeypatch):
    """The number of (group, text) rows of each comparison."""
    counts, compare = [], near_dedup.compare

    def counted(groups, texts, percent):
        counts.append(groups.count())
        return compare(groups, texts, percent)

    monkeypatch.setattr(near_dedup, "compare", counted)
    return counts


def test_alike_texts_are_read_once_an_anchor(spark, monkeypatch):
    """400 texts in blocks of one: no copies by blocks of the bucket, and nothing left once all are one class."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 1)
    counts = read_rows(monkeypatch)
    assert {r.component_id for r in near_dedup.near_duplicates(df).collect()} == {0}
    whole, anchored, rest = counts
    assert whole == 0 and rest == 0
    assert anchored <= 2 * 400 * near_dedup.HALVES**2 / 4  # an anchor's row for each of its texts' rows


@pytest.mark.parametrize("texts, shingles", [(1, 500_000), (4, 500_000), (15, 1_000)])
def test_classes_that_share_buckets(spark, monkeypatch, texts, shingles):
    """Two clusters that are nearly alike, a chain from one to nowhere and single texts, in small blocks."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    other = edited(rng, base[:100], 3) + [f"o{i}" for i in range(20)]
    made = [edited(rng, base, 1) for _ in range(25)] + [edited(rng, other, 1) for _ in range(25)]
    chain = list(base)
    for _ in range(25):
        chain = edited(rng, chain, 2)
        made.append(chain)
    made += [edited(rng, base, 9) for _ in range(10)]
    rng.shuffle(made)
    rows = [(3 * k, " ".join(w)) for k, w in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    counts = read_rows(monkeypatch)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows)[0]
    assert len(set(got.values())) > 2 and counts[2] > 0


def test_every_two_texts_of_an_anchor_share_a_group(spark, monkeypatch):
    """But those that are both linked with it; an anchor that is linked with all of its texts has no group."""
    rng = random.Random(2)
    rows = [(a, b, 50) for a in (1, 2, 3) for b in rng.sample(range(10, 70), 40)] + [(4, b, 50) for b in range(10, 40)]
    linked = [(a, b) for a, b, _ in rows if a in (1, 4) and b % 3 or a == 4] + [(10, 11), (1, 10), (1, 10)]
    meets = spark.createDataFrame(rows, "a long, b long, n_shingles long")
    near = spark.createDataFrame(linked, "a long, b long")
    for texts in (1, 6, 200):
        monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", texts)
        groups: dict = {}
        for r in near_dedup.apart_from_anchors(meets, near).collect():
            groups.setdefault(r.group, set()).add(r.rep)
        met = {(a, b) for g in groups.values() for a in g for b in g}
        for key in (1, 2, 3):
            mine = [b for a, b, _ in rows if a == key]
            done = {b for a, b in linked if a == key}
            assert all((x, y) in met or {x, y} <= done for x in mine for y in mine)
        assert all(len(g) <= max(2, 8 * texts) for g in groups.values())
    alone = near_dedup.apart_from_anchors(meets.where("a = 4"), near)
    assert alone.count() == 0
