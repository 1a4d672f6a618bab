"""Tables on pages: grids of words with places, and rows of cells between delimiters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances on a page, in points or in heights of a word (fixed values).
CELL_GAP, CELL_GAP_HEIGHTS = 12.0, 1.8
SPACE_GAP, SPACE_GAP_HEIGHTS = 1.0, 0.15
BASELINE, BASELINE_HEIGHTS = 1.5, 0.45
OVERLAP = -0.5
ROW_GAP_HEIGHTS = 3.5
ANCHOR = 8.0
SIDE_GAP, SIDE_SHARE = 48.0, 1.8
#: Words and signs that a cell of the first row and any cell may have (fixed values).
HEAD_CELL, ANY_CELL = (2, 40), (8, 80)

ROW = [("row_no", pa.int64()), ("y", pa.float64()), ("height", pa.float64()), ("ambiguous", pa.bool_()), ("cells", pa.list_(pa.struct([("x", pa.float64()), ("end", pa.float64()), ("text", pa.string())])))]


def cells_of(line: list[tuple]) -> tuple[list[dict], bool]:
    """Cells of one row of (x, width, height, text), and whether words lie over each other."""
    cells, over, end = [], False, None
    for x, width, height, text in sorted(line, key=lambda f: f[0]):
        gap = None if end is None else x - end
        end = x + width
        over |= gap is not None and gap < OVERLAP
        if gap is None or gap > max(CELL_GAP, CELL_GAP_HEIGHTS * height):
            cells.append({"x": x, "end": end, "text": text})
        else:
            cells[-1]["text"] += (" " if gap > max(SPACE_GAP, SPACE_GAP_HEIGHTS * height) else "") + text
            cells[-1]["end"] = end
    for c in cells:
        c["text"] = c["text"].strip()
    return cells, over


def text_rows(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, y, height, ambiguous, cells) from words (keys, x, y, width, height, text), y downwards.

    A row goes on while words stand near its first word's baseline, so rows can't be
    told by neighbours alone: sorted pages are read as a stream that holds one row.
    Blank words and words without a place are left out.
    """
    k = len(keys)
    placed = F.lit(True)
    for c in ("x", "y", "width", "height"):
        placed = placed & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    words = fragments.where(placed & (F.trim("text") != "")).select(*keys, *(F.col(c).cast("double").alias(c) for c in ("y", "x", "width", "height")), "text")
    types = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, number, line, start = None, 0, [], 0.0
        kinds: list[pa.Field] = []
        rows: list[tuple] = []

        def close() -> None:
            cells, over = cells_of(line)
            rows.append((*page, number, start, max(f[2] for f in line), over, cells))

        def batch() -> pa.RecordBatch:
            *columns, cells = zip(*rows)
            flat = [[c[n] for each in cells for c in each] for n in ("x", "end", "text")]
            kind = ROW[-1][1]
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind.value_type)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, cells), initial=0)), pa.int32()), structs)
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, kinds)), lists.cast(kind)], schema=pa.schema(kinds))

        for b in batches:
            kinds = kinds or [*(b.schema.field(c) for c in keys), *(pa.field(*f) for f in ROW)]
            for f in zip(*(c.to_pylist() for c in b.columns)):
                key, (y, x, width, height, text) = f[:k], f[k:]
                if line and (key != page or abs(y - start) > max(BASELINE, BASELINE_HEIGHTS * height)):
                    close()
                    line = []
                if not line:
                    number, start = number + 1 if key == page else 1, y
                page = key
                line.append((x, width, height, text))
            if rows:
                yield batch()
        if line:
            close()
            yield batch()

    dealt = words.repartition(*keys).sortWithinPartitions(*keys, "y", "x", "text")
    return dealt.mapInArrow(run, f"{types}, row_no long, y double, height double, ambiguous boolean, cells array<struct<x: double, end: double, text: string>>")


def _compact(text: Column, words: int, signs: int) -> Column:
    breaks = F.length(text) - F.length(F.regexp_replace(text, "\\s", ""))
    return (F.length(text) <= signs) & ~text.rlike("[.?!]$") & (breaks < words)


def position_cells(fragments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, table_no, row_no, column_no, x, text, columns, quality): the cells of all tables of words with places.

    A table is a run of rows of two cells or more that are near each other, with
    the row of one cell right before it, if near; two rows at least. A run is prose,
    and no table, if a cell ends a sentence or is long (in its first wide row: has
    over two words). STRONG has three rows or more with equal numbers of cells,
    cells of a column that begin near the first one, no words over each other and
    no gap that parts two tables side by side; all others are LIMITED. Null keys
    are a page of their own.

    Rows are shuffled once, by page; runs, columns and tables are windows in that
    partitioning, which spill, so no table is held in memory.
    """
    keys = keys or ["page"]
    page = [f"__{k}" for k in keys]  # other names than those below; a window takes null keys as one page
    w = Window.partitionBy(*page).orderBy("row_no")
    near = lambda y, y0, h0: F.coalesce(y - y0 <= ROW_GAP_HEIGHTS * F.greatest(h0, F.col("height")), F.lit(False))
    rows = text_rows(fragments, keys).select(*(F.col(k).alias(p) for k, p in zip(keys, page)), "row_no", "y", "height", "ambiguous", "cells", F.size("cells").alias("n"))
    rows = rows.withColumns({
        "joins": near(F.col("y"), F.lag("y").over(w), F.lag("height").over(w)),
        "heads": F.coalesce(F.lead("n").over(w) >= 2, F.lit(False)) & near(F.lead("y").over(w), F.col("y"), F.lead("height").over(w)),
        "follows": F.coalesce(F.lag("n").over(w) >= 2, F.lit(False)),
    })
    runs = rows.where("n >= 2 or heads").withColumn("run", F.count_if((F.col("n") == 1) | ~F.col("joins")).over(w))
    first_wide = (F.col("n") >= 2) & ~(F.col("joins") & F.col("follows"))
    gap = F.try_element_at("cells", F.col("i") + 2)["x"] - F.col("c.end")
    cells = runs.select("*", F.posexplode("cells").alias("i", "c")).select(*page, "run", "row_no", "n", "ambiguous", first_wide.alias("first"), "i", "c.x", "c.text", gap.alias("gap"))

    column = Window.partitionBy(*page, "run", "i")
    cells = cells.withColumns({"anchor": F.min_by("x", "row_no").over(column), "gap": F.avg("gap").over(column), "rows": F.count("*").over(column)})
    table = Window.partitionBy(*page, "run")
    long = ~_compact(F.col("text"), *ANY_CELL) | (F.col("first") & ~_compact(F.col("text"), *HEAD_CELL))
    cells = cells.withColumns({"rows": F.max("rows").over(table), "prose": F.bool_or(long).over(table), "widest": F.max_by("i", "gap").over(table)}).where("rows >= 2 and not prose")
    largest, second = F.max("gap").over(table), F.max(F.when(F.col("i") != F.col("widest"), F.col("gap"))).over(table)
    apart = (F.max("n").over(table) >= 4) & (largest >= SIDE_GAP) & (largest > SIDE_SHARE * second)
    even = (F.min("n").over(table) == F.max("n").over(table)) & (F.max(F.abs(F.col("x") - F.col("anchor"))).over(table) <= ANCHOR)
    strong = (F.col("rows") >= 3) & even & ~F.bool_or("ambiguous").over(table) & ~apart
    number = lambda w: F.dense_rank().over(w).cast("long")
    return cells.select(
        *(F.col(p).alias(k) for p, k in zip(page, keys)),
        number(Window.partitionBy(*page).orderBy("run")).alias("table_no"), number(Window.partitionBy(*page, "run").orderBy("row_no")).alias("row_no"), (F.col("i") + 1).cast("long").alias("column_no"),
        "x", "text", F.max("n").over(table).cast("long").alias("columns"), F.when(strong, "STRONG").otherwise("LIMITED").alias("quality"),
    )


def position_tables(fragments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, table_no, rows, columns, quality, content): cells with tabs between them in a STRONG table, else spaces.

    The content is one value, as large as its table; ``position_cells`` has no such value.
    """
    keys = keys or ["page"]
    cells = position_cells(fragments, keys)
    between = F.when(F.col("column_no") > 1, F.when(F.col("quality") == "STRONG", "\t").otherwise(" ")).when(F.col("row_no") > 1, "\n").otherwise("")
    texts = F.array_sort(F.collect_list(F.struct("row_no", "column_no", F.concat(between, "text").alias("text"))))
    return cells.groupBy(*keys, "table_no").agg(F.max("row_no").alias("rows"), F.max("columns").alias("columns"), F.max("quality").alias("quality"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("content"))


def _joined(order: str, line: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")


def delimited_rows(lines: DataFrame) -> DataFrame:
    """Lines (material_id, page_number, line_no, line) that are rows: with ``cells``, ``width`` and ``sep``.

    A row has tabs or pipes, not both; outer pipes go; no cell is empty; two cells at least.
    """
    tab, pipe = F.contains("line", F.lit("\t")), F.contains("line", F.lit("|"))
    inner = F.regexp_replace(F.regexp_replace("line", "^\\s+|\\s+$", ""), "^\\||\\|$", "")
    cells = F.when(tab & ~pipe, F.split("line", "\t")).when(pipe & ~tab, F.split(inner, "\\|"))
    cells = F.transform(cells, lambda x: F.trim(x))
    rows = lines.withColumns({"cells": cells, "sep": F.when(tab, "\t").otherwise(" | ")})
    return rows.where("size(cells) >= 2 and not exists(cells, x -> x = '')").withColumn("width", F.size("cells").cast("long"))


def delimited_tables(lines: DataFrame) -> DataFrame:
    """(material_id, page_number, first_line, rows, width, content): runs of two rows or more with one delimiter and width.

    The content has the trimmed cells with tabs, or with a pipe between spaces.
    """
    w = Window.partitionBy("material_id", "page_number").orderBy("line_no")
    new = (F.lag("line_no").over(w) != F.col("line_no") - 1) | (F.lag("width").over(w) != F.col("width")) | (F.lag("sep").over(w) != F.col("sep"))
    rows = delimited_rows(lines).withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    rows = rows.withColumn("row", F.when(F.col("sep") == "\t", F.array_join("cells", "\t")).otherwise(F.array_join("cells", " | ")))
    return rows.groupBy("material_id", "page_number", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("rows"), F.max("width").alias("width"), _joined("line_no", "row").alias("content")).where("rows >= 2").drop("run")
