"""Word tables read by blocks of lines against the same read line by line."""

import gzip
import io
import random

import pytest

from lectern.plans import streaming_queries
from lectern.sources import word_tables as wt

HEAD = "\t".join(wt.NAMES)
ODD = ["", "x", "0x1f", "-", "+5", " 7", "1_0", "99999999999", "-1", "1e1", "nan", "101", "2.5", "a\tb"]


def by_line(data, most_rows, most_chars):
    return list(wt.words_of(io.TextIOWrapper(io.BytesIO(data), "utf-8", newline=""), "f", most_rows, most_chars))


def outcome(read, *args):
    try:
        return read(*args)
    except (wt.Malformed, OverflowError) as e:
        return str(e)


def test_blocks_give_what_lines_give(monkeypatch):
    """plain lines are read by column, others one by one, with the same words and errors."""
    rng, plain = random.Random(3), 0

    def by_block(data, most_rows, most_chars):
        nonlocal plain
        at, out = wt._At(), []
        for block in wt._blocks(io.BytesIO(data)):
            words = wt.plain_words(block, "f", most_rows, most_chars, at)
            plain += words is not None
            out += list(wt.words_of(io.TextIOWrapper(io.BytesIO(block), "utf-8", newline=""), "f", most_rows, most_chars, at)) if words is None else [tuple(r.values()) for r in words.to_pylist()]
        return out

    for _ in range(2_000):
        rows, page, n = [HEAD], 1, 0
        for _ in range(rng.randrange(12)):
            page, n = page + (rng.random() < 0.2), n + (rng.random() < 0.97)
            row = ["5", str(page), "1", "1", str(page), str(n), "0", rng.choice(["0", "-3"]), "9", "9", rng.choice(["90", "1.5", ".5"]), rng.choice(["a", "Größe", " x ", " ", "\x1cz", ""])]
            if rng.random() < 0.1:
                row[0], row[10] = "1", "-1"
            if rng.random() < 0.05:
                row[rng.randrange(12)] = rng.choice(ODD)
            rows += ["\t".join(row), *[""] * (rng.random() < 0.02)]
        data = (rng.choice(["\n", "\n", "\r\n"]).join(rows) + rng.choice(["", "\n"])).encode()
        monkeypatch.setattr(wt, "BLOCK", rng.choice([7, 60, 500]))
        limits = rng.choice([5, 100]), rng.choice([3, 100])
        assert outcome(by_block, data, *limits) == outcome(by_line, data, *limits)
    assert plain > 500


def test_tables_may_be_compressed(spark, tmp_path):
    (tmp_path / "a.tsv.gz").write_bytes(gzip.compress(f"{HEAD}\n5\t1\t1\t1\t0\t1\t0\t0\t0\t0\t9\tö\n".encode()))
    assert [r.text for r in wt.read_word_tables(spark, f"file://{tmp_path}").collect()] == ["ö"]
    (tmp_path / "b.tsv").write_text("")
    with pytest.raises(Exception, match="b.tsv: another header"):
        wt.read_word_tables(spark, f"file://{tmp_path}").collect()


def test_texts_are_dealt_not_words(spark, tmp_path):
    """words in their order come from texts in theirs; texts without a word are in no table."""
    texts = [(0, 'b "a"\n\n c'), (1, None), (2, ' \n"'), (999, "x"), (1000, "y\tz"), (3000, "")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = streaming_queries.QUERIES["read_word_tables"](spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2, 2), (0, 2, 1, 1), (999, 0, 1, 1), (1000, 0, 2, 2)]
