"""Readers of files with a strict form, and content detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Beginnings of known file types (fixed values).
MAGIC = (("%PDF-", "application/pdf"), ("\x89PNG", "image/png"), ("PK\x03\x04", "application/zip"), ("<!DOCTYPE html", "text/html"), ("<html", "text/html"))
KINDS = {"application/pdf": "DOCUMENT", "text/html": "WEB_PAGE", "image/png": "IMAGE"}
#: The columns of a word table, in order (fixed values).
WORD_COLUMNS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def sniff_content(files: DataFrame, content: Column, declared: Column, max_size: int) -> DataFrame:
    """Adds detected type, kind, and a reason to reject: EMPTY, TOO_LARGE, UNKNOWN or MISMATCH with the declared type."""
    found = F.lit(None).cast("string")
    for head, kind in MAGIC:
        found = F.when(F.startswith(F.lower(content), F.lit(head.lower())), kind).otherwise(found)
    said = F.lower(F.trim(F.element_at(F.split(declared, ";"), 1)))
    size = F.octet_length(content)
    files = files.withColumns({"detected": found, "__said": said, "__size": size})
    material = F.lit(None).cast("string")
    for k, v in KINDS.items():
        material = F.when(F.col("detected") == k, v).otherwise(material)
    reason = F.when(F.col("__size") == 0, "EMPTY").when(F.col("__size") > max_size, "TOO_LARGE").when(F.col("detected").isNull(), "UNKNOWN").when(F.col("detected") != F.col("__said"), "MISMATCH")
    return files.withColumns({"kind": material, "reason": reason}).drop("__said", "__size")


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, corpus and judgements of a golden dataset in JSON."""
    schema = "version string, cases array<struct<id:string,query:string,subject:string,difficulty:string,vector:array<double>,expected:array<string>,acceptable:array<string>,irrelevant:array<string>>>, corpus array<struct<id:string,content:string,section:string,vector:array<double>>>"
    data = spark.read.schema(schema).option("multiLine", True).json(path)
    cases = data.select("version", F.explode("cases").alias("c")).select("version", "c.*")
    corpus = data.select("version", F.explode("corpus").alias("c")).select("version", "c.*")
    grades = F.create_map(F.lit("EXPECTED"), F.col("expected"), F.lit("ACCEPTABLE"), F.col("acceptable"), F.lit("IRRELEVANT"), F.col("irrelevant"))
    judged = cases.select(F.col("id").alias("query_id"), F.explode(grades).alias("grade", "ids")).select("query_id", "grade", F.explode("ids").alias("chunk_id"))
    return cases.drop("expected", "acceptable", "irrelevant"), corpus, judged


def read_ocr_words(spark: SparkSession, path: str, most_rows: int | None = None, ordered: bool = False) -> DataFrame:
    """A word table with tabs and an exact header; a malformed row or a wrong header is an error.

    With ``most_rows``, a larger table is an error too, and with ``ordered`` one whose
    words don't follow each other on their page.
    """
    names = [c.split()[0] for c in WORD_COLUMNS.split(", ")]
    header = spark.read.text(path).first()
    if header is None or header[0].split("\t") != names:
        raise ValueError("the word table has another header")
    rows = spark.read.schema(WORD_COLUMNS).option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("quote", "").csv(path)
    if most_rows is not None and rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"the word table has more than {most_rows} rows")
    words = rows.where("level = 5").drop("level")
    if ordered and not order_violations(words).isEmpty():
        raise ValueError("words stand before their predecessors")
    return words


def order_violations(words: DataFrame) -> DataFrame:
    """Words that stand before their predecessor on the page."""
    key = F.struct("block_num", "par_num", "line_num", "word_num")
    w = Window.partitionBy("page_num").orderBy("__place")
    return words.withColumn("__place", F.monotonically_increasing_id()).withColumn("__before", F.lag(key).over(w)).where(key <= F.col("__before")).drop("__before", "__place")
