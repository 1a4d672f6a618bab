"""Column functions of the library in one place, and the table function for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.operators.chunking import count_tokens, split_oversized
from lectern.operators.evaluation import phrase_match, semantic_tokens
from lectern.operators.retrieval import cosine_similarity, trigrams
from lectern.operators.text import byte_tokens, canonical_line, chunk_uuid, comparison_key, escape_xml, token_count

__all__ = ["byte_tokens", "canonical_line", "chunk_uuid", "comparison_key", "cosine_similarity", "count_tokens", "escape_xml", "phrase_match", "register", "semantic_tokens", "split_oversized", "token_count", "trigrams"]


@udtf(returnType="line_no: int, cells: array<string>")
class DelimitedRows:
    """The rows of a text that are cells between tabs or between pipes."""

    def eval(self, text: str):
        for n, line in enumerate((text or "").split("\n")):
            tab, pipe = "\t" in line, "|" in line
            if tab == pipe:
                continue
            raw = line.split("\t") if tab else line.strip().strip("|").split("|")
            cells = [c.strip() for c in raw]
            if len(cells) >= 2 and all(cells):
                yield n, cells


def register(spark: SparkSession) -> None:
    """Makes ``delimited_rows(text)`` known to SQL."""
    spark.udtf.register("delimited_rows", DelimitedRows)
