"""Pairs of a similarity from a bound on, from one reading of the texts, against trying all stretches."""

import random

import numpy as np
import pytest

from lectern.operators import extents, retrieval


def single(query, text):
    """One pair by itself; ``test_extents`` holds this against trying all stretches."""
    codes = extents.ordered_trigrams(text)
    return extents.best_extent(codes, extents.places_before(codes), np.unique(extents.ordered_trigrams(query)))


def invented(rng, n, parts=("ab", "ca", "bo", "de", "fé", "gi", "ho", "ju")):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85])
def test_search_equals_all_stretches(monkeypatch, least):
    rng = random.Random(3)
    monkeypatch.setattr(extents, "_CELLS", 2_000)
    monkeypatch.setattr(extents, "_SHORT", 6)
    texts = ["", "?"] + [invented(rng, rng.randrange(60)) for _ in range(40)] + ["zz " * 300 + "abca fébo", "abca bode " * 40]
    asked = [invented(rng, rng.randrange(1, 12)) for _ in range(25)] + ["", "abca bode gi"]
    for t in texts[5:9]:  # long ones that are there, a word off
        asked.append(" ".join(t.split()[2:20] + ["xyz"]))
    search = extents.StretchSearch([np.unique(extents.ordered_trigrams(a)) for a in asked], least)
    got = {(int(t), int(q)): round(float(s), 6) for t, q, s in zip(*search.best(texts))}
    want = {(t, q): round(single(a, text), 6) for t, text in enumerate(texts) for q, a in enumerate(asked)}
    assert got == {k: v for k, v in want.items() if v >= least and v > 0} and len(got) > 20


def test_trigrams_of_many_texts():
    texts = ["É-tude Œ 😀 7", "", "ΑΣ ΑΣ", "\n\n", "one two"]
    codes, offsets = extents.trigrams_of(texts)
    for k, t in enumerate(texts):
        assert codes[offsets[k] : offsets[k + 1]].tolist() == extents.ordered_trigrams(t).tolist()


def test_no_text_or_pair_is_shuffled(spark):
    """the pairs to look at came from joins of all words, and nearly all were scored."""
    rng = random.Random(4)
    texts = {k: invented(rng, 30) for k in range(50)} | {50: None, 51: ""}
    asked = {k: invented(rng, 1 + k % 9) for k in range(15)} | {15: None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    found = retrieval.word_similarity(queries, chunks, 0.5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, k): round(single(a or "", t or ""), 6) for q, a in asked.items() for k, t in texts.items()}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert {(r.query_id, r.chunk_id): r.similarity for r in found.collect()} == want and want
    assert {(r.query_id, r.chunk_id): r.similarity for r in extents.similar_extents(queries, chunks, 0.5, block=4).collect()} == want
