"""Words, literal texts and covers of one pass against plain loops."""

import random
import re

from lectern.operators import retrieval, signals
from lectern.plans import carriers


def plain_rank(words, wanted):
    ends = {}
    for e in range(len(words)):
        last = [max((k for k in range(e + 1) if words[k] == w), default=-1) for w in wanted]
        if min(last) >= 0:
            ends.setdefault(min(last), e)
    return round(sum(1 / (e - s + 1) for s, e in ends.items()), 6) if ends else None


def test_signals_equal_plain_loops(spark, monkeypatch):
    """no word is shuffled, and the covers are those of all stretches."""
    rng = random.Random(5)
    line = lambda most: " ".join(rng.choice(["a", "b", "ab", "c-d", "É", "x_y"]) for _ in range(rng.randrange(most)))
    texts = {k: line(30) for k in range(60)} | {60: None, 61: ""}
    asked = {k: line(5) for k in range(25)} | {25: None, 26: "?", 27: "a b c"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = {(q, k): plain_rank(cut(t), sorted(set(cut(a)))) for q, a in asked.items() for k, t in texts.items() if cut(a)}
    want = {k: v for k, v in want.items() if v is not None}
    found = retrieval.cover_density(queries, chunks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.chunk_id): r.rank for r in found.collect()} == want
    held = {(q, k) for q, a in asked.items() for k, t in texts.items() if a and t is not None and a.lower() in t.lower()}
    assert {(r.query_id, r.chunk_id) for r in signals.lexical_signals(queries, chunks, literal=True, block=7).collect()} == held
    monkeypatch.setattr(signals, "_CELLS", 3)
    import numpy as np

    for _ in range(50):
        words, wanted = np.array([rng.randrange(4) for _ in range(30)]), np.array(sorted(rng.sample(range(4), 3)))
        got = signals.cover_rank(np.arange(30), words, wanted)
        assert (got and round(got, 6)) == plain_rank(words.tolist(), wanted.tolist())


def test_texts_of_other_chunks_stay_out_of_the_page_order(spark, tmp_path):
    """page numbers are those of all documents, texts those of the wanted ones."""
    spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 2}") for i in range(6)], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    every = {r.chunk_id: r for r in carriers.k_chunks(spark, f"file://{tmp_path}").collect()}
    some = {r.chunk_id: r for r in carriers.k_chunks(spark, f"file://{tmp_path}", only=spark.createDataFrame([(3,), (3,), (5,)], "chunk_id long")).collect()}
    assert len(some) == 6 and {k for k, r in some.items() if r.content} == {3, 5}
    assert all(some[k].asDict() | {"content": None} == r.asDict() | {"content": None} for k, r in every.items()) and some[5] == every[5]
