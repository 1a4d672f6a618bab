"""Small golden cases of operators that have no SQL form, and plan checks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import columns
from lectern.operators import chunking, evaluation, integrity, learner, retrieval, text
from lectern.sources import readers
from lectern.streaming import state


def test_token_counters_agree(spark):
    texts = ["", "a", "abcd efghi", "Größe-2, ok!", "x" * 9 + " 12345", "naïve  …", "हिन्दी पाठ", "e\u0301tude cafe\u0301", "a\u00a0b\u2003c\u202fd\u3000e\x1cf\x85g", "x²½Ⅷ٣", "😀 a😀b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(text.token_count(F.col("t")).alias("n")).collect()] == [chunking.count_tokens(t) for t in texts]


def test_long_units_are_split_inside_the_limit():
    body = "One two three. " * 50 + "w" * 400
    parts = chunking.split_oversized(body, 40)
    assert all(chunking.count_tokens(p) <= 40 for p in parts)
    assert "".join(body.split()) == "".join("".join(parts).split())


def test_both_ways_of_splitting_agree():
    rng = random.Random(6)
    for _ in range(200):
        body = "".join(rng.choice(["word", "longerword", " ", " ", ". ", "\n", "\t", "-", "é", "12"]) for _ in range(rng.randint(0, 80)))
        for hard in (1, 3, 10):
            assert chunking.split_oversized(body, hard) == chunking.split_oversized(body, hard, lambda t: chunking.count_tokens(t))


def test_the_whole_chunking_job(spark):
    pages = spark.createDataFrame([("m", p, "NATIVE", None, f"page {p} " + "word " * 40) for p in (1, 2, 3)], "material_id string, page_number long, extraction_method string, quality string, content string")
    nodes = spark.createDataFrame([("m", "r", None, "DOCUMENT", "Book", 1, 1, 3, 0), ("m", "c", "r", "CHAPTER", "One", 1, 1, 2, 1), ("m", "d", "r", "CHAPTER", "Two", 2, 3, 3, 1)], "material_id string, node_id string, parent_id string, node_type string, title string, ordinal long, start_page long, end_page long, depth long")
    visuals = spark.createDataFrame([(7, "m", 1, "c"), (8, "m", 3, "d"), (9, "m", 3, "c")], "visual_id long, material_id string, page_number long, node_id string")
    out = sorted(integrity.chunk_material_text(pages, nodes, visuals, 60, 100, 5).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in out] == [*range(1, len(out) + 1)] and {r.node_id for r in out} == {"c", "d"}
    assert {(r.heading_path, tuple(r.visual_ids)) for r in out if r.start_page == 1} == {("Book > One", (7,))}
    assert {(r.heading_path, tuple(r.visual_ids)) for r in out if r.start_page == 3} == {("Book > Two", (8,))}


def test_chunks_break_at_nodes_and_carry_an_overlap(spark):
    rows = [("m", i, i // 3 + 1, "n1" if i < 6 else "n2", "NATIVE", f"para{i} " + "word " * 8) for i in range(9)]
    units = spark.createDataFrame(rows, "material_id string, unit_no int, page_number long, node_id string, extraction_method string, text string")
    out = sorted(chunking.pack_chunks(units, target=30, hard=60, overlap=100).collect(), key=lambda r: (r.segment, r.part))
    assert {r.node_id for r in out} == {"n1", "n2"} and all(r.tokens <= 60 for r in out)
    first, second = out[0].content.split("\n\n"), out[1].content.split("\n\n")
    assert first[-1] == second[0]  # the last paragraph begins the next chunk
    n2 = [r for r in out if r.node_id == "n2"]
    assert n2[0].content.startswith("para6")  # nothing is carried over a node
    assert {p.split()[0] for r in out for p in r.content.split("\n\n")} == {f"para{i}" for i in range(9)}


def test_queries_with_phrases_alternatives_and_exclusions(spark):
    chunks = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown quick dogs"), (3, "lazy dogs sleep"), (4, "a quick brown cat")], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "quick brown"), (2, '"quick brown"'), (3, '"quick brown" -cat'), (4, "fox or sleep"), (5, "missing")], "query_id long, query string")
    got = {}
    for r in retrieval.fts_match(queries, chunks).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {1, 2, 4}, 2: {1, 4}, 3: {1}, 4: {1, 3}}


def test_literal_match_has_no_wildcards(spark):
    chunks = spark.createDataFrame([(1, "100% of\ncases"), (2, "100 of cases"), (3, "UNDER_score"), (4, "some plain words here"), (5, "xsome plain wordsy")], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "100%"), (2, "r_S"), (3, "%"), (4, "some plain words"), (5, ""), (6, "some  plain words")], "query_id long, query string")
    assert {(r.query_id, r.chunk_id) for r in retrieval.literal_match(queries, chunks).collect()} == {(1, 1), (2, 3), (3, 1), (4, 4), (4, 5)}


def test_vector_search_skips_zero_vectors_and_breaks_ties_by_id(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    for block in (5_000, 1):
        got = [(r.query_id, r.vec_id, r.rank_no) for r in retrieval.vector_search(q, e, 2, most_values=block).orderBy("rank_no").collect()]
        assert got == [(9, 1, 1), (9, 2, 2)]
    assert retrieval.vector_search(q.where("query_id = 8"), e).count() == 0


def test_word_similarity(spark):
    chunks = spark.createDataFrame([(1, "brachial plexus"), (2, "radial nerve")], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "brachial")], "query_id long, query string")
    assert [(r.chunk_id, r.similarity) for r in retrieval.word_similarity(queries, chunks).collect()] == [(1, 1.0)]


def test_lexical_search_finds_misspelt_words_and_orders_by_trigrams(spark):
    chunks = spark.createDataFrame([(1, "the radial nerve"), (2, "brachial plexus block"), (3, "fox and hound"), (4, "fox or hounds")], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "brachal plexus"), (2, "fox or hounds"), (3, "%")], "query_id long, query string")
    got = sorted(((r.query_id, r.rank_no, r.chunk_id, r.exact, r.trigram) for r in retrieval.lexical_search(queries, chunks).collect()))
    assert [g[:4] for g in got] == [(1, 1, 2, False), (2, 1, 4, True), (2, 2, 3, False)]
    # 13 of the 15 trigrams of "brachal plexus" stand in "brachial plexus", which has 16; of "fox and hound" the stretch "  h" to "und"
    # has 5 of 14, "  f" to "fox " 4, and all of it 9, with 4 others; it comes in by its word alone
    assert [g[4] for g in got] == [round(13 / 18, 6), 1.0, round(9 / 18, 6)]
    strict = retrieval.lexical_search(queries, chunks, similarity=0.95).collect()
    assert {(r.query_id, r.chunk_id, r.trigram) for r in strict} == {(2, 4, 1.0), (2, 3, round(9 / 18, 6))}
    ties = spark.createDataFrame([(1, "fox xx"), (2, "fox lynxes")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "fox or lynx")], "query_id long, query string")
    assert [r.chunk_id for r in retrieval.lexical_search(asked, ties).orderBy("rank_no").collect()] == [2, 1]


def test_policies_are_checked():
    with pytest.raises(ValueError):
        retrieval.FusionPolicy(0, 0)
    with pytest.raises(ValueError):
        retrieval.FusionPolicy(float("nan"))
    with pytest.raises(ValueError):
        learner.PolicyConfiguration(hint_after=3, simplify_after=3)


def test_negated_phrases_are_not_asserted(spark):
    df = spark.createDataFrame([("The nerve is not the median nerve.", "median nerve"), ("The median nerve.", "median nerve"), ("x", "")], "t string, p string")
    got = [(r.a, r.m) for r in df.select(evaluation.phrase_match(F.col("t"), F.col("p")).alias("a"), evaluation.phrase_match(F.col("t"), F.col("p"), False).alias("m")).collect()]
    assert got == [(False, True), (True, True), (False, False)]


def test_texts_cut_inside_a_word_are_contained(spark):
    rows = [(1, "the zebra network classification of many other different things entirely"), (2, "zebra network classificat"), (3, "ra network classification of many"), (4, "zebra networ"), (5, "nothing alike here")]
    got = {(r.a, r.b) for r in evaluation.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 4)}


def test_near_duplicate_questions_equal_a_plain_loop(spark):
    rng = random.Random(3)
    words = ["a", "is", "it", "zebra", "zebras", "net", "network", "networks", "of", "cell", "cells"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(200, "Cell!"), (201, "  cell "), (202, None), (203, "?!"), (204, "bra net"), (205, "twork"), (206, "a"), (207, "s i")]
    norm = {i: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()) for i, t in rows}
    first = {}
    for i in sorted(norm):
        if norm[i]:
            first.setdefault(norm[i], i)
    want = {(first[t], i) for i, t in norm.items() if t and first[t] != i}
    reps = sorted(first.values())
    for a in reps:
        for b in reps:
            x, y = ({w for w in norm[k].split() if len(w) > 2} for k in (a, b))
            if a < b and (norm[a] in norm[b] or norm[b] in norm[a] or ((x | y) and len(x & y) >= 0.75 * len(x | y))):
                want.add((a, b))
    assert {(r.a, r.b) for r in evaluation.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()} == want


def test_next_action_ladder(spark):
    base = dict(mission_id=1, status="ACTIVE", stage="RETRIEVAL", concept=1, available_minutes=60, grounding="GENERAL_KNOWLEDGE", source_state="READY", has_text=True, visual_needed=False, visual_state="PRESENT", connection_relevant=False)
    missions = spark.createDataFrame([base]).withColumns({"template": F.lit(None).cast("string"), "question_intent": F.lit(None).cast("string")}).withColumn("started_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("mission_id", F.col("mission_id").cast("long")).withColumn("concept", F.col("concept").cast("long"))
    want = {0: "UNDERSTAND", 1: "RETRY", 2: "HINT", 3: "UNDERSTAND", 4: "PREREQUISITE_SUPPORT", 5: "RETRY", 6: "RETRY"}
    for failures, action in want.items():
        rows = [(i, 1, 1, i + 1, "RETRIEVE", "FOUNDATIONAL", "INCORRECT") for i in range(failures)]
        attempts = spark.createDataFrame(rows, "event_id long, mission_id long, concept long, sequence long, activity string, difficulty string, outcome string").withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "template": F.lit("t1"), "question_intent": F.lit("q1")})
        got = learner.next_actions(learner.assemble_states(attempts, missions, "2024-01-01 00:10:00")).first()
        assert got.action == action, failures


def test_throttle_equals_a_plain_loop(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), 1_700_000_000 + rng.randrange(600)) for i in range(200)]
    src = spark.createDataFrame(rows, "event_id long, address long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    src.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/e")
    got = {r.event_id: r.allowed for r in state.run_to_end(state.stream_throttle(stream, 5, 60), "append").collect()}
    opened, used, want = {}, {}, {}
    for i, a, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if a not in opened or t >= opened[a] + 60:
            opened[a], used[a] = t, 0
        want[i] = used[a] < 5
        used[a] += want[i]
    assert got == want and not all(want.values())


def test_golden_files_and_word_tables(spark, tmp_path):
    data = {"version": "v", "cases": [{"id": "c", "query": "q", "subject": "s", "difficulty": "d", "vector": [1.0], "expected": ["k"], "acceptable": [], "irrelevant": ["z"]}], "corpus": [{"id": "k", "content": "x", "section": "1", "vector": [0.5]}]}
    (tmp_path / "g.json").write_text(json.dumps(data, indent=1))
    cases, corpus, judged = readers.read_golden(spark, f"file://{tmp_path}/g.json")
    assert cases.count() == corpus.count() == 1 and {(r.grade, r.chunk_id) for r in judged.collect()} == {("EXPECTED", "k"), ("IRRELEVANT", "z")}
    head = "\t".join(c.split()[0] for c in readers.WORD_COLUMNS.split(", "))
    (tmp_path / "w.tsv").write_text(head + "\n1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t91.5\tb\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t80\ta\n")
    words = readers.read_ocr_words(spark, f"file://{tmp_path}/w.tsv")
    assert [r.text for r in words.collect()] == ["b", "a"] and [r.text for r in readers.order_violations(words).collect()] == ["a"]
    (tmp_path / "bad.tsv").write_text("level\tother\n")
    with pytest.raises(ValueError):
        readers.read_ocr_words(spark, f"file://{tmp_path}/bad.tsv")


def test_embedding_function_must_answer_each_id(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, content string")
    none = spark.createDataFrame([], "chunk_id long, generation long")

    def half(frames):
        for f in frames:
            f = f.head(1)
            f["embedding"] = [[1.0]] * len(f)
            yield f

    with pytest.raises(Exception, match="each id once"):
        retrieval.embed_missing(chunks.coalesce(1), none, 1, half).collect()


def test_table_function(spark):
    columns.register(spark)
    assert [(r.line_no, r.cells) for r in spark.sql("SELECT * FROM delimited_rows('| a | b |\nplain\nx\ty')").collect()] == [(0, ["a", "b"]), (2, ["x", "y"])]


def test_cycles_and_closure(spark):
    n = spark.createDataFrame([("m", "a", None), ("m", "b", "a"), ("m", "c", "b"), ("m", "x", "z"), ("m", "y", "x"), ("m", "z", "y"), ("m", "t", "z")], "material_id string, node_id string, parent_id string")
    assert {r.node_id for r in integrity.cycle_nodes(n).collect()} == {"x", "y", "z"}
    tree = n.where("node_id in ('a','b','c')")
    assert {(r.ancestor, r.descendant, r.distance) for r in integrity.node_closure(tree).collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_deep_outlines_and_loops(spark):
    chain = [("m", f"n{i}", f"n{i - 1}" if i else None) for i in range(90)]
    deep = spark.createDataFrame(chain, "material_id string, node_id string, parent_id string")
    assert integrity.cycle_nodes(deep).count() == 0
    assert integrity.node_closure(deep.where("length(node_id) < 3")).groupBy().max("distance").first()[0] == 9
    assert integrity.node_closure(deep.where("length(node_id) = 2 or node_id rlike '^n[1-3].$'")).count() == 40 * 41 // 2
    loop = spark.createDataFrame([("m", "x", "y"), ("m", "y", "x")], deep.schema)
    with pytest.raises(ValueError, match="own ancestor"):
        integrity.node_closure(loop)
    with pytest.raises(ValueError, match="deeper"):
        integrity.node_closure(deep, max_depth=5)


def test_ranking_sees_only_what_the_owner_may_see(spark):
    chunks = spark.createDataFrame(
        [(1, "red fox", "a", True, "m1", "n1", 3), (2, "red fox", "b", True, "m1", "n1", 0), (3, "red fox", "a", False, "m1", "n1", 0), (4, "red fox", "a", True, "m2", "n2", 1), (5, "red fox", "a", True, "m2", "n3", 1)],
        "chunk_id long, content string, owner_id string, is_active boolean, material_id string, node_id string, chunk_index long",
    )
    queries = spark.createDataFrame([(1, "red fox", "a"), (2, "red fox", "c")], "query_id long, query string, owner_id string")
    hits = lambda scope=None: [(r.query_id, r.chunk_id) for r in retrieval.lexical_search(queries, chunks, 10, scope=scope).orderBy("query_id", "rank_no").collect()]
    assert hits() == [(1, 4), (1, 5), (1, 1)]  # by chunk_index, then id
    scope = spark.createDataFrame([(1, "m1", None), (1, "m2", "n3"), (2, "m1", None)], "query_id long, material_id string, node_id string")
    assert hits(scope) == [(1, 5), (1, 1)]
    assert hits(scope.where("query_id = 2")) == []
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), "owner_id", "chunk_index", F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    asked = queries.withColumn("embedding", F.array(F.lit(2.0), F.lit(1.0)))
    got = retrieval.vector_search(asked, vectors, 2, by=["owner_id"], tie="chunk_index").orderBy("rank_no").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 3), (1, 4)]


def test_channels_must_agree(spark):
    hits = spark.createDataFrame([(1, 7, 1, "m"), (1, 8, 2, "m")], "query_id long, chunk_id long, rank_no long, material_id string")
    assert retrieval.merge_channels(hits, hits, ["material_id"]).count() == 2
    with pytest.raises(Exception, match="twice"):
        retrieval.merge_channels(hits.unionByName(hits), hits).collect()
    with pytest.raises(Exception, match="disagree"):
        retrieval.merge_channels(hits, hits.withColumn("material_id", F.lit("other")), ["material_id"]).collect()


def test_vector_generations(spark):
    e = spark.createDataFrame([(1, "g", "x", [1.0, 0.0]), (2, "h", "x", [1.0, 0.0]), (3, "g", "y", [1.0, 0.0]), (4, "g", "x", [1.0]), (5, "g", "x", None)], "vec_id long, generation string, model string, embedding array<double>")
    g = spark.createDataFrame([("g", "x", 2)], "generation string, model string, dimension int")
    assert {(r.vec_id, r.reason) for r in retrieval.embedding_violations(e, 0, g).collect()} == {(2, "GENERATION"), (3, "MODEL"), (4, "DIMENSION"), (5, "MISSING")}
    q = spark.createDataFrame([(1, 1, 1, True, False, "x", [1.0]), (2, 1, 1, False, False, "x", [1.0]), (3, 1, 1, True, True, None, None), (4, 1, 1, True, False, "y", [1.0]), (5, 1, 1, True, False, "x", [0.0]), (6, 0, 1, True, False, "x", [1.0])], "query_id long, scope_size int, generations int, provider boolean, failed boolean, model string, embedding array<double>").withColumn("generation_model", F.lit("x"))
    assert {r.query_id: r.status for r in retrieval.vector_status(q, 1).collect()} == {1: "AVAILABLE", 2: "NO_PROVIDER", 3: "FAILED", 4: "INCOMPATIBLE", 5: "INVALID", 6: "EMPTY_SCOPE"}


def test_comparison_keys(spark):
    cases = {"  Ⅷ. Ｆｉｎｅ ﬁsh!! ": "viii. fine fish", "“Quoted” • text": "“quoted” • text", "--A\u00a0 B--": "a b", "É-tude;": "é-tude", None: None, "x" * 600: "x" * 512}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.k for r in df.select("t", text.comparison_key(F.col("t")).alias("k")).collect()} == cases


def test_two_batches_give_the_chunks_of_one(spark, tmp_path):
    docs = [(i, f"m{i % 3}", "\n\n".join(f"paragraph {i} {k} " + "word " * 30 for k in range(4))) for i in range(12)]
    schema = "doc_id long, source string, text string"

    def chunks(batch):
        pages = batch.select(F.concat_ws("/", "source", "doc_id").alias("material_id"), F.lit(1).cast("long").alias("page_number"), F.lit("NATIVE").alias("extraction_method"), F.col("text").alias("content"))
        return chunking.chunk_documents(pages, pages.select("material_id", "page_number", F.lit("n").alias("node_id")), 20, 40, 5).select("chunk_id", "material_id", "chunk_index", "content")

    def run(name, parts):
        for n, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}-in")
            stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{name}-in")
            state.stream_ingest(stream, chunks, f"file://{tmp_path}/{name}", ["chunk_id"], f"file://{tmp_path}/{name}-state")
        return sorted((r.chunk_id, r.content) for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect())

    one, two = run("one", [docs]), run("two", [docs[:5], docs[5:]])
    assert one == two and len(one) > 12
    changed = [(docs[0][0], docs[0][1], docs[0][2].replace("paragraph", "PARAGRAPH"))]
    assert run("two", [changed]) == two  # what is stored stays
    assert spark.read.parquet(f"file://{tmp_path}/two-conflicts").where("content like 'PARAGRAPH%'").count() > 0


def test_outline_takes_over_headings(spark):
    lines = spark.createDataFrame([("m", 1, 0, "1. Introduction to cells", "NATIVE", None), ("m", 1, 1, "body text", "NATIVE", None), ("m", 2, 0, "nothing", "NATIVE", None), ("m", 3, 0, "2. Other things", "NATIVE", None)], "material_id string, page_number long, line_no long, line string, extraction_method string, quality string")
    pages = lines.groupBy("material_id", "page_number", "extraction_method", "quality").agg(F.max("line").alias("content"))
    outline = spark.createDataFrame([("m", 1, "INTRODUCTION to cells", 2, 1), ("m", 2, "Hidden part", 5, 2), ("m", 3, "Absent part", 1, 3)], "material_id string, page_number long, title string, depth long, source_order long")
    got = {(r.page_number, r.title, r.level, r.score, r.confidence, r.origin) for r in text.apply_outline(text.score_headings(lines), outline, lines, pages).collect()}
    assert got == {(1, "1. Introduction to cells", 2, 6, "HIGH", "NATIVE"), (2, "Hidden part", 3, 4, "MEDIUM", "NATIVE"), (3, "2. Other things", 1, 4, "LOW", "HEURISTIC")}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("m", 1, 1, "PAGE_TEXT", 1, "t", "big")], "material_id string, page_number long, doc_id long, block_type string, ordinal long, content string, other string").write.parquet(f"file://{tmp_path}/p")
    plan = integrity.scan_blocks(spark.read.parquet(f"file://{tmp_path}/p"), "m", 1, 5).select("doc_id", "page_number")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "material_id,m)" in pushed and "GreaterThanOrEqual(page_" in pushed and "other" not in plan.split("ReadSchema")[1]


def test_blocks_in_reading_order(spark):
    rows = [("m", 2, "TABLE_TEXT", 1), ("m", 2, "PAGE_TEXT", 5), ("m", 1, "TABLE_TEXT", 9), ("m", 1, "TABLE_TEXT", 2), ("m", 1, "CAPTION", 1), ("n", 1, "PAGE_TEXT", 1), ("m", 3, "PAGE_TEXT", 1), ("m", 1, None, 1), (None, 1, "PAGE_TEXT", 1)]
    blocks = spark.createDataFrame(rows, "material_id string, page_number long, block_type string, ordinal long").repartition(3)
    assert [(r.page_number, r.block_type, r.ordinal) for r in integrity.scan_blocks(blocks, "m", 1, 2).collect()] == [(1, "TABLE_TEXT", 2), (1, "TABLE_TEXT", 9), (2, "PAGE_TEXT", 5), (2, "TABLE_TEXT", 1)]
    for first, last in ((0, 2), (3, 2)):
        with pytest.raises(ValueError):
            integrity.scan_blocks(blocks, "m", first, last)


def test_failed_cases_by_model(spark):
    results = spark.createDataFrame([(1, "p", "a", "t", "", True), (2, "p", "a", "t", "BLANK,TOO_LONG", False), (3, "p", None, "t", "BLANK", False)], "id long, provider string, model string, task string, failed string, passed boolean")
    assert {tuple(r) for r in evaluation.failed_cases(results).collect()} == {("p", "a", "t", 2, "BLANK"), ("p", "a", "t", 2, "TOO_LONG"), ("p", None, "t", 3, "BLANK")}
    rates = {(r.model, r.level): (r.cases, r.failed_cases, r.pass_rate) for r in evaluation.pass_rates(results).collect() if r.provider and r.task}
    assert rates == {("a", 0): (2, 1, 0.5), (None, 0): (1, 1, 0.0), (None, 2): (3, 2, round(1 / 3, 9))}
    assert {r.model for r in evaluation.pass_rates(results.drop("model")).collect()} == {None}
