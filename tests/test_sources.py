"""Word tables as a source, and tables that grow by numbered batches."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lectern.sources import committed, word_tables

HEAD = "\t".join(word_tables.NAMES)


def word(page, line, n, text, conf=90, level=5):
    return "\t".join(map(str, (level, page, 1, 1, line, n, 0, 0, 10, 10, conf, text)))


GOOD = [HEAD, word(1, 0, 0, "", -1, 1), word(1, 1, 1, "Größe"), word(1, 1, 2, "  "), word(1, 1, 3, "lost", -1), "", word(1, 2, 1, " 2.5 "), word(2, 1, 1, '"a"')]
BAD = {
    "another header": [HEAD.replace("conf", "confidence"), word(1, 1, 1, "a")],
    "fields": [HEAD, word(1, 1, 1, "a") + "\tb"],
    "not a number": [HEAD, word("x", 1, 1, "a")],
    "without a word": [HEAD, word(1, 1, 1, "a", 50, 4)],
    "out of range": [HEAD, word(0, 1, 1, "a")],
    "out of range ": [HEAD, word(1, 1, 1, "a", 101)],
    "before its predecessor": [HEAD, word(1, 2, 1, "a"), word(1, 1, 9, "b")],
    "before its predecessor ": [HEAD, word(1, 1, 1, "a"), word(1, 1, 1, "b")],
    "more than 5 rows": [HEAD, *(word(1, 1, n, "a") for n in range(1, 7))],
    "header": [],
}


def test_word_tables(spark, tmp_path):
    os.makedirs(tmp_path / "t" / "deep")
    (tmp_path / "t" / "a.tsv").write_text("\r\n".join(GOOD))
    (tmp_path / "t" / "deep" / "b.tsv").write_text("\n".join(GOOD) + "\n")
    (tmp_path / "t" / "empty.tsv").write_text(HEAD)
    (tmp_path / "t" / "_SUCCESS").write_text("")
    df = word_tables.read_word_tables(spark, f"file://{tmp_path}/t", task_bytes=1)
    assert df.rdd.getNumPartitions() == 3
    got = sorted((r.file[-5:], r.row_no, r.page_num, r.line_num, r.word_num, r.conf, r.text) for r in df.collect())
    one = [(2, 1, 1, 1, 90.0, "Größe"), (6, 1, 2, 1, 90.0, "2.5"), (7, 2, 1, 1, 90.0, '"a"')]
    assert got == [(f, *w) for f in ("a.tsv", "b.tsv") for w in one]
    assert word_tables.read_word_tables(spark, f"file://{tmp_path}/t/a.tsv").count() == 3


@pytest.mark.parametrize("reason", BAD)
def test_malformed_word_tables(reason):
    with pytest.raises(word_tables.Malformed, match=reason.strip()):
        list(word_tables.words_of(iter(BAD[reason]), "f", 5, 100))


def test_malformed_table_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("\n".join([HEAD, "x"]))
    with pytest.raises(Exception, match="bad.tsv, row 1"):
        word_tables.read_word_tables(spark, f"file://{tmp_path}").collect()


def test_no_word_tables(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert word_tables.read_word_tables(spark, f"file://{tmp_path}/none").count() == 0


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_are_there_once(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None), (2, None, None)], "id long, text string, v array<double>").repartition(2)
    committed.append_committed(df, folder, 0)
    committed.append_committed(df.coalesce(1), folder, 0)
    committed.append_committed(df.limit(0), folder, 1)
    committed.append_committed(df.where("id = 1"), folder, 2)
    assert rows(committed.read_committed(spark, folder)) == rows(df.unionByName(df.where("id = 1")))
    assert committed.read_committed(spark, folder).schema == df.schema
    for other in (df.where("id = 1"), df.withColumn("text", F.lit("b"))):
        with pytest.raises(Exception, match="came again"):
            committed.append_committed(other, folder, 0)
    assert committed.read_committed(spark, folder).count() == 4
    assert len(os.listdir(tmp_path / "t" / "data")) == sum(len(e["files"]) for e in committed._Log(folder).entries())


def test_failed_batch_is_not_there(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        committed.append_committed(broken, folder, 0)
    assert committed.read_committed(spark, folder, "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, folder)


def test_stream_that_starts_anew_adds_nothing(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    spark.range(10).write.parquet(source)

    def run(state):
        committed.stream_committed(spark.readStream.schema("id long").parquet(source).withColumn("x", F.col("id") * 2), folder, f"file://{tmp_path}/{state}").awaitTermination()
        return committed.read_committed(spark, folder).count()

    assert run("state") == 10
    shutil.copytree(tmp_path / "state", tmp_path / "before")
    spark.range(10, 15).write.mode("append").parquet(source)
    assert run("state") == 15
    assert run("before") == 15  # the second batch again, as after a failure before its commit was noted
    assert rows(committed.read_committed(spark, folder)) == sorted(((n, 2 * n) for n in range(15)), key=repr)
