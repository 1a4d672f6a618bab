"""Tiny batches, and tables with columns named like the operators' own."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import containment, language_id, line_spread, near_dedup, textkit

CLASH = ["gone", "places", "place", "__n", "__gone", "__id", "__null", "__text", "__places", "__LANG_PRED", "lang_score", "Lang_Pred", "Gone"]


def test_batches_of_few_words():
    """Every total of 0 to 6 words in a batch, in two texts of every length and a null one."""
    for total in range(7):
        for first in range(total + 1):
            texts = [" ".join("abcdefg"[:first]), " ".join("abcdefg"[first:total]), None]
            grams, bounds = textkit.shingles_of(*textkit.utf8(pa.array(texts, pa.string())))
            sizes = [max(n - 4, 1) if n else 0 for n in (first, total - first, 0)]
            assert bounds.tolist() == [0, sizes[0], sizes[0] + sizes[1], sizes[0] + sizes[1]] and len(grams) == sum(sizes)
            alone = textkit.shingles_of(*textkit.utf8(pa.array(texts[:1], pa.string())))[0]
            assert (grams[: sizes[0]] == alone).all()


@pytest.mark.parametrize("texts", [["a b"], ["a b", "c d"], ["", None, "q r s"]])
def test_operators_on_few_words(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    assert all(r.component_id == r.doc_id for r in near_dedup.near_duplicates(docs).collect())
    assert near_dedup.near_dedup_stage(spark, docs, "").count() == len(rows)
    items = spark.createDataFrame([(9, texts[-1])], "item_id long, text string")
    assert {r.doc_id for r in containment.find_contained(docs, items).collect()} == {i for i, t in rows if t == texts[-1] and t}
    assert {r.doc_id for r in containment.without_contained(docs, items).collect()} == {i for i, t in rows if t != texts[-1] or not t}


def test_stages_keep_columns_of_any_name(spark):
    """Spark compares names without case, so each clash has a table of its own."""
    text = "the line that all have\nsome words of this text only number %d and a few more of them"
    rows = [(k, text % (k // 2), "en", f"s{k}") for k in range(24)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for names in (CLASH[:11], CLASH[10:]):
        docs = base.select("*", *[F.lit(c).alias(c) for c in names if c.lower() not in ("doc_id",)])
        for out in (line_spread.lines_stage(spark, docs, ""), near_dedup.near_dedup_stage(spark, docs, ""), language_id.language_stage(spark, docs, "")):
            assert out.columns == docs.columns
            kept = out.collect()
            assert kept and all(r[c] == c for r in kept for c in names)
    assert line_spread.lines_stage(spark, base.withColumn("gone", F.lit(1)), "").where("text like 'the line%'").count() == 1


def test_equal_items_go_out_once(spark, monkeypatch):
    """Thousands of equal items make no block of more than one, and each of them is reported."""
    sizes = []
    build = containment.ItemBlock.__init__
    monkeypatch.setattr(containment.ItemBlock, "__init__", lambda block, ids, texts: sizes.append(len(ids)) or build(block, ids, texts))
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"zero {text} eight"), (2, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)] * 500 + [(None, text)] * 2 + [(8, "other words that stand in no document")], "item_id long, text string")
    got = [tuple(r) for r in containment.find_contained(docs, items, block_items=2).collect()]
    assert sorted(got, key=repr) == sorted([(1, 7, 3, 3)] * 500 + [(1, None, 3, 3)] * 2, key=repr)
    assert sum(sizes) == 3


def test_training_sample_is_bounded_by_signs(spark):
    """However many languages there are, the sample has no more signs than its bound, and each language has its share."""
    rows = [(n, f"l{n % 40}", "abcde fghij " * (1 + n % 7)) for n in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sample = language_id.training_sample(docs, "doc_id", "text", "lang", 50, 30, 60, 9_000).groupBy("lang").agg(F.sum(F.length("text")).alias("signs"), F.count("*").alias("texts")).collect()
    assert len(sample) == 30 and all(240 < r.signs <= 300 for r in sample)
    few = language_id.training_sample(docs, "doc_id", "text", "lang", 50, 30, 60, 10**9).groupBy("lang").count().collect()
    assert {r["count"] for r in few} == {50}
