"""Chunks against a plain walk over signs and units."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, integrity, text

SPACE = {9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x1680, 0x2028, 0x2029, 0x205F, 0x3000, *range(0x2000, 0x2007), 0x2008, 0x2009, 0x200A}


def is_word(ch):
    kind = unicodedata.category(ch)
    return kind[0] == "L" or kind in ("Nd", "Mn", "Mc", "Me")


def plain_count(t):
    total = run = 0
    for ch in t + "\n":
        if is_word(ch):
            run += 1
        else:
            total += (run + 3) // 4 + (ord(ch) not in SPACE)
            run = 0
    return total


def plain_split(t, hard, table):
    if plain_count(t) <= hard:
        return [t]
    out, start = [], 0
    while start < len(t):
        end = start
        while end < len(t) and plain_count(t[start : end + 1]) <= hard:
            end += 1
        if end < len(t):
            piece = t[start:end]
            last = lambda signs: max((k for k, ch in enumerate(piece) if ch in signs), default=-1)
            order = ["\n", "\t"] if table else [".!?"]
            cut = next((k for k in map(last, order) if k >= 0), -1)
            cut = cut if cut >= 0 else max((k for k, ch in enumerate(piece) if ord(ch) in SPACE), default=-1)
            end = start + cut + 1 if cut >= 0 else end
        out.append(t[start:end])
        start = end
    return out


def plain_pack(units, target, hard, overlap):
    """[(content, tokens, pages, node, method, type, quality, [overlap flags])] of one material's units in order."""
    out, held, tail = [], [], None
    rank = {"STRONG": 0, "LIMITED": 1, "POOR": 2}

    def flush():
        nonlocal held, tail
        if any(not h[-1] for h in held):
            first = held[0][0]
            body = "\n\n".join(h[1] for h in held)
            grades = [h[0]["quality"] for h in held if h[0]["quality"]]
            out.append((body, plain_count(body), sorted({h[0]["page"] for h in held if not h[-1]}), first["node"], first["method"], first["type"], max(grades, key=rank.get, default=None), [h[-1] for h in held]))
            tail = held[-1] if first["type"] == "TEXT" and not held[-1][-1] else None
        held = []

    for u in units:
        pieces = plain_split(u["text"], hard, u["type"] == "TABLE")
        for p in pieces:
            n = plain_count(p)
            if not n:
                continue
            alike = not held or all(held[0][0][k] == u[k] for k in ("node", "method", "type"))
            if held and (not alike or sum(h[2] for h in held) + n > target):
                flush()
            if not held and u["type"] == "TEXT" and tail and not tail[3] and tail[2] <= overlap and tail[0]["node"] == u["node"] and tail[0]["method"] == u["method"]:
                held = [(*tail[:4], True)]
            if held and sum(h[2] for h in held) + n > hard:
                flush()
            held.append((u, p, n, len(pieces) > 1, False))
            if u["type"] == "TABLE":
                flush()
    flush()
    return out


PIECES = ["word", "longerword", " ", " ", ". ", "\n", "\t", "-", "é", "12", "3.5", " ", " ", "?", "हि", "😀"]


def some_text(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))


def test_counts_and_splits():
    rng = random.Random(6)
    for _ in range(400):
        body = some_text(rng, 80)
        assert chunking.count_tokens(body) == plain_count(body)
        for hard, table in ((1, False), (3, True), (10, False), (10, True)):
            want = plain_split(body, hard, table)
            assert chunking.split_oversized(body, hard, table=table) == want
            assert chunking.split_oversized(body, hard, lambda t: plain_count(t), table) == want
            assert "".join(want) == body
    with pytest.raises(ValueError):
        chunking.split_oversized("ab", 1, lambda t: 5 * len(t))
    assert len(chunking.split_oversized("w" * 400_000, 1_000)) == 100


@pytest.mark.parametrize("limits", [(12, 16, 5), (30, 30, 100), (8, 8, 0)])
def test_packing(spark, limits):
    rng = random.Random(sum(limits))
    rows = []
    for m in range(4):
        for k in range(60):
            rows.append((f"m{m}", k // 4 + 1, k % 4, rng.choice(["n1", "n1", "n1", "n2"]) if m else "n1", rng.choice(["NATIVE"] * 5 + ["OCR"]), rng.choice(["TEXT"] * 6 + ["TABLE"]), rng.choice(["STRONG", "LIMITED", "POOR", None]), some_text(rng, 25)))
    units = spark.createDataFrame(rows + [("m0", 99, 0, "n1", "NATIVE", "TEXT", None, None)], "material_id string, page_number long, unit long, node_id string, extraction_method string, content_type string, quality string, text string")
    got = chunking.number_chunks(chunking.pack_chunks(units.repartition(3), *limits, order=("page_number", "unit"))).collect()
    for m in range(4):
        mine = [dict(zip(("page", "unit", "node", "method", "type", "quality", "text"), r[1:])) for r in rows if r[0] == f"m{m}"]
        out = sorted((r for r in got if r.material_id == f"m{m}"), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in out] == [*range(1, len(out) + 1)]
        assert [(r.content, r.tokens, r.primary_pages, r.node_id, r.extraction_method, r.content_type, r.quality, [s.overlap for s in r.sources]) for r in out] == plain_pack(mine, *limits)
        assert all((r.start_page, r.end_page) == (min(r.primary_pages), max(r.primary_pages)) for r in out)


def test_a_unit_that_would_pass_the_target_begins_a_chunk(spark):
    rows = [("m", 1, "n", "NATIVE", "word " * 500), ("m", 2, "n", "NATIVE", "word " * 400), ("m", 3, "n", "NATIVE", "word " * 90), ("m", 4, "n", "NATIVE", "tail"), ("m", 5, "n", "NATIVE", "  ")]
    units = spark.createDataFrame(rows, "material_id string, unit_no long, node_id string, extraction_method string, text string").withColumn("page_number", F.col("unit_no"))
    out = sorted(chunking.pack_chunks(units).collect(), key=lambda r: r.part)
    assert [(r.tokens, r.primary_pages) for r in out] == [(500, [1]), (491, [2, 3, 4])]
    many = chunking.pack_chunks(units, count=lambda t: 2 * chunking.count_tokens(t)).collect()  # a counter of the caller's
    assert max(r.tokens for r in many) <= 1_000 and len(many) > 2


def test_tables_and_blocks_of_a_page(spark):
    pages = spark.createDataFrame([("m", 1, 2, "NATIVE", "TABLE", "a\tb\n\nc\td"), ("m", 1, 1, "NATIVE", None, "one\n\ntwo"), ("m", 1, 3, "NATIVE", "TEXT", "three"), ("m", 2, 1, "NATIVE", "TEXT", None)], "material_id string, page_number long, block_no long, extraction_method string, content_type string, content string")
    out = sorted(chunking.chunk_documents(pages, pages.select("material_id", "page_number", F.lit("n").alias("node_id")).distinct()).collect(), key=lambda r: r.chunk_index)
    assert [(r.content_type, r.content) for r in out] == [("TEXT", "one\n\ntwo"), ("TABLE", "a\tb\n\nc\td"), ("TEXT", "three")]
    assert chunking.chunk_documents(pages.limit(0), pages.select("material_id", "page_number", F.lit("n").alias("node_id"))).count() == 0


def test_pages_are_located_as_by_all_ranges(spark):
    rng = random.Random(8)
    nodes = [(f"m{m}", f"{m}-{k}", None if k == 0 else f"{m}-0", k % 4 if k else 0, rng.choice([1, 1, 2]), *(sorted((rng.randrange(1, 70), rng.randrange(1, 70))) if k else (None, None))) for m in range(3) for k in range(25)]
    nodes += [("m1", "bad", "1-0", 9, 1, 30, 20), ("m9", "9-1", "9-0", 1, 1, 5, 2**31)]
    schema = "material_id string, node_id string, parent_id string, depth long, ordinal long, start_page long, end_page long"
    pages = [(f"m{m}", p) for m in (0, 1, 2, 9) for p in (*range(1, 80), 1, 10**9)]
    got = {(r.material_id, r.page_number): r.node_id for r in integrity.locate_nodes(spark.createDataFrame(pages, "material_id string, page_number long"), spark.createDataFrame(nodes, schema)).collect()}
    for m, p in pages:
        hits = [n for n in nodes if n[0] == m and n[5] is not None and n[5] <= p <= n[6]]
        best = max(hits, key=lambda n: (n[3], n[5] - n[6], n[5], n[4], n[1]))[1] if hits else f"{m[1]}-0" if m != "m9" else None
        assert got.get((m, p)) == best
    assert text.SPACE_CLASS.count("-") == len(text.SPACES)


def test_exact_quantiles_of_hot_groups_and_sketches(spark):
    rng = random.Random(1)
    rows = [("hot", "a", "S", rng.choice([1.0, 2.0, 2.5]), k) for k in range(3_000)] + [(rng.choice(["hot", "b", None]), rng.choice(["a", "c"]), "F", rng.random() * 9 if k % 7 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "provider string, task string, status string, latency double, n long").repartition(4)
    keys = ["provider", "task", "status"]
    got = {tuple(r[:4]): tuple(r[4:]) for r in integrity.exact_quantiles(df, keys, "latency", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    want = {}
    for level in range(4):
        for r in rows:
            if r[3] is not None:
                want.setdefault((*r[:level], *[None] * (3 - level), (1 << 3 - level) - 1), []).append(r[3])
    assert got == {k: tuple(sorted(v)[max(-(-len(v) * p // 100) - 1, 0)] for p in (0, 50, 95, 100)) for k, v in want.items()}
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("n") * 600))
    rolled = integrity.roll_up_sketches(integrity.usage_sketches(timed)).collect()
    whole = next(r for r in rolled if r.requests == len(rows))
    values = sorted(r[3] for r in rows if r[3] is not None)
    assert whole["values"] == len(values)
    for estimate, p in ((whole.median_latency, 0.5), (whole.p95_latency, 0.95)):
        low, high = sum(v < estimate for v in values) / len(values), sum(v <= estimate for v in values) / len(values)
        assert low - 0.015 <= p <= high + 0.015
