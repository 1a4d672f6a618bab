"""Chunks of pages: units, splitting of long ones, packing, numbers and ids."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import stored
from lectern.operators.text import SPACE_CLASS, SPACES, chunk_uuid, paragraphs


class _Kinds(dict):
    """The kind of each code point, found once: w in words (letters, digits, marks), blank for white space, s for other signs."""

    def __missing__(self, point: int) -> str:
        category = unicodedata.category(chr(point))
        kind = "w" if category[0] in "LM" or category == "Nd" else " " if any(a <= point <= b for a, b in SPACES) else "s"
        self[point] = kind
        return kind


_KINDS = _Kinds()
_RUN = re.compile("w+")


def count_tokens(text: str) -> int:
    """The same count as ``token_count``, for use inside tasks."""
    kinds = text.translate(_KINDS)
    return kinds.count("s") + sum(-(-len(run) // 4) for run in _RUN.findall(kinds))


class _Cuts:
    """Where pieces of a text end that hold at most so many tokens; each piece counts its first word from its own beginning."""

    def __init__(self, text: str):
        self.kinds = text.translate(_KINDS)
        cost = (np.frombuffer(self.kinds.encode("ascii"), np.uint8) == ord("s")).astype(np.int64)
        for m in _RUN.finditer(self.kinds):
            cost[m.start() : m.end() : 4] = 1
        self.sums = np.concatenate([[0], np.cumsum(cost)])

    def end(self, start: int, most: int) -> int:
        inside = _RUN.match(self.kinds, start)
        rest = inside.end() if inside else start  # of a word that the piece before may have cut
        if rest - start > 4 * most:
            return start + 4 * most
        left = most - -(-(rest - start) // 4)
        return int(np.searchsorted(self.sums, self.sums[rest] + left, side="right")) - 1


def split_oversized(text: str, hard: int, count: Callable[[str], int] = count_tokens, table: bool = False) -> list[str]:
    """The text if it has at most ``hard`` tokens, else pieces of at most as many that make it up again.

    A piece ends behind the last sentence sign (of a table: the last row, else the
    last cell) in what fits, else behind the last white space, else where the
    limit is. With the own count the text is looked at once; another ``count``,
    which must not fall with longer texts, is asked in bisection.
    """
    if count(text) <= hard:
        return [text]
    cuts = _Cuts(text)
    parts, start = [], 0
    while start < len(text):
        if count is count_tokens:
            end = cuts.end(start, hard)
        else:
            end, high = start, len(text)
            while end < high:
                mid = (end + high + 1) // 2
                end, high = (mid, high) if count(text[start:mid]) <= hard else (end, mid - 1)
        if end <= start:
            raise ValueError("a sign of the text has more tokens than a piece may have")
        if end < len(text):
            signs = ("\n",), ("\t",) if table else (".", "!", "?")
            wanted = signs if table else signs[1:]
            found = next((at for group in wanted if (at := max(text.rfind(s, start, end) for s in group)) >= start), -1)
            if found < 0:
                found = cuts.kinds.rfind(" ", start, end)
            end = found + 1 if found >= start else end
        parts.append(text[start:end])
        start = end
    return parts


_QUALITY = {"STRONG": 0, "LIMITED": 1, "POOR": 2}


@dataclass
class _Packer:
    """The chunks of one run of units that agree in node, method and type; holds one chunk and the paragraph before it."""

    target: int
    hard: int
    overlap: int
    count: Callable[[str], int]
    table: bool
    held: list[tuple] = field(default_factory=list)  # (text, tokens, page, unit, quality, fragment, carried)
    tokens: int = 0
    trailing: tuple | None = None

    def add(self, text: str, page: int, unit: int, quality: str | None) -> Iterator[tuple]:
        whole = self.count(text)
        pieces = [text] if whole <= self.hard else split_oversized(text, self.hard, self.count, self.table)
        for piece in pieces:
            n = whole if len(pieces) == 1 else self.count(piece)
            if not n:
                continue
            if self.held and self.tokens + n > self.target:
                yield from self.flush()
            if not self.held and self.trailing and not self.table:
                last = self.trailing
                if not last[5] and last[1] <= self.overlap and last[1] + n <= self.hard:
                    self.held, self.tokens = [(*last[:6], True)], last[1]
            self.held.append((piece, n, page, unit, quality, len(pieces) > 1, False))
            self.tokens += n
            if self.table:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.held:
            content = "\n\n".join(h[0] for h in self.held)
            own = [h for h in self.held if not h[6]]
            worst = max((h[4] for h in self.held if h[4] is not None), key=lambda q: _QUALITY.get(q, 0), default=None)
            sources = [(h[2], h[3], k, h[6]) for k, h in enumerate(self.held, 1)]
            # white space parts the pieces, so by the own count they cost together what each costs
            tokens = sum(h[1] for h in self.held) if self.count is count_tokens else self.count(content)
            yield content, tokens, min(h[2] for h in own), max(h[2] for h in own), sorted({h[2] for h in own}), worst, sources
            self.trailing = None if self.table else self.held[-1]
        self.held, self.tokens = [], 0


_CHUNK = pa.schema([
    ("material_id", pa.string()), ("segment", pa.int64()), ("part", pa.int64()), ("content", pa.string()), ("tokens", pa.int64()), ("start_page", pa.int64()), ("end_page", pa.int64()),
    ("primary_pages", pa.list_(pa.int64())), ("node_id", pa.string()), ("extraction_method", pa.string()), ("content_type", pa.string()), ("quality", pa.string()),
    ("sources", pa.list_(pa.struct([("page_number", pa.int64()), ("unit", pa.int64()), ("position", pa.int32()), ("overlap", pa.bool_())]))),
])


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows in the order of ``_CHUNK``, the sources as tuples."""
    *columns, sources = zip(*rows)
    kind = _CHUNK.field("sources").type
    offsets = pa.array(np.cumsum([0, *map(len, sources)]), pa.int32())
    flat = zip(*(x for each in sources for x in each))
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind.value_type)], fields=list(kind.value_type))
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _CHUNK)), pa.ListArray.from_arrays(offsets, structs).cast(kind)], schema=_CHUNK)


_CHUNK_SCHEMA = (
    "material_id string, segment long, part long, content string, tokens long, start_page long, end_page long, primary_pages array<long>, node_id string, "
    "extraction_method string, content_type string, quality string, sources array<struct<page_number:long,unit:long,position:int,overlap:boolean>>"
)


def pack_chunks(units: DataFrame, target: int = 800, hard: int = 1000, overlap: int = 100, count: Callable[[str], int] = count_tokens, order: tuple[str, ...] = ("unit_no",)) -> DataFrame:
    """(material_id, segment, part, content, tokens, start_page, end_page, primary_pages, node_id, extraction_method, content_type, quality, sources).

    ``units``: (material_id, the columns of ``order``, page_number, node_id,
    extraction_method, text), and where they are there content_type (TEXT or TABLE;
    else all TEXT) and quality. A chunk ends before a unit of another node, method
    or type, before one that would take it over ``target`` tokens, and after a
    table. A text chunk begins with the last paragraph of the one before it, if
    that is whole, has at most ``overlap`` tokens and fits the ``hard`` limit with the
    next unit; it doesn't count for the pages. Units of more than ``hard`` tokens
    are split. Units without a token, and null texts, are left out. ``tokens`` is
    the count of the content, ``quality`` the worst of its units, and ``sources``
    the units in order, by page and the last column of ``order``.

    Runs of units are numbered on rows without texts. Texts are shuffled once, by
    node, method and type, which a run agrees in, and sorted; among them stands a row
    for the beginning of each run, with its number. A run is packed as a stream that
    holds one chunk.
    """
    kind = F.coalesce("content_type", F.lit("TEXT")) if "content_type" in units.columns else F.lit("TEXT")
    quality = F.col("quality") if "quality" in units.columns else F.lit(None).cast("string")
    # any sign that isn't white space costs a token
    some = units.where(F.col("text").rlike(f"[^{SPACE_CLASS}]")).select("material_id", *order, F.col("page_number").cast("long").alias("page"), "node_id", "extraction_method", kind.alias("content_type"), quality.alias("quality"), "text")
    alike = ["node_id", "extraction_method", "content_type"]
    w = Window.partitionBy("material_id").orderBy(*order, *alike)
    # with the quality both readings of the units need the same columns, so that what is shuffled for them is used twice
    slim = some.select("material_id", *order, *alike, "quality").distinct()
    new = ~F.lag(F.struct(*alike)).over(w).eqNullSafe(F.struct(*alike))
    runs = slim.withColumn("new", new.cast("int")).withColumn("segment", F.sum("new").over(w).cast("long")).where("new = 1").drop("new")
    cut = some.withColumn("segment", F.lit(None).cast("long")).unionByName(runs, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer, part, out = None, None, 0, []

        def rows(chunks: Iterator[tuple]) -> None:
            nonlocal part
            for content, tokens, first, last, pages, worst, sources in chunks:
                material, segment, node, method, content_type = key
                out.append((material, segment, part, content, tokens, first, last, pages, node, method, content_type, worst, sources))
                part += 1

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(9)]
            for material, segment, node, method, content_type, page, unit, worst, text in zip(*columns):
                if segment is not None:  # a run begins
                    if packer:
                        rows(packer.flush())
                    key, part = (material, segment, node, method, content_type), 0
                    packer = _Packer(target, hard, overlap, count, content_type == "TABLE")
                    continue
                rows(packer.add(text, page, unit, worst))
                if len(out) >= 500:
                    yield _chunk_batch(out)
                    out = []
        if packer:
            rows(packer.flush())
        if out:
            yield _chunk_batch(out)

    dealt = cut.repartition("material_id", *alike).sortWithinPartitions("material_id", *alike, *order, F.col("segment").isNull())
    return dealt.select("material_id", "segment", "node_id", "extraction_method", "content_type", "page", F.col(order[-1]).cast("long"), "quality", "text").mapInArrow(run, _CHUNK_SCHEMA)


def number_chunks(packed: DataFrame) -> DataFrame:
    """Adds chunk_index, from 1 in each material, and the chunk's id; only counts of segments are put in order.

    The chunks are read twice, for the numbers of segments and with them, so they are written first.
    """
    packed = stored(packed, "packed")
    w = Window.partitionBy("material_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = packed.groupBy("material_id", "segment").agg(F.count("*").alias("n")).select("material_id", "segment", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    index: Column = (F.col("before") + F.col("part") + 1).cast("long")
    return packed.join(before, ["material_id", "segment"]).withColumn("chunk_index", index).drop("before").withColumn("chunk_id", chunk_uuid(F.col("material_id"), F.col("chunk_index")))


def chunk_documents(pages: DataFrame, located: DataFrame, target: int = 800, hard: int = 1000, overlap: int = 100, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Pages to chunks with numbers and ids; ``located``: (material_id, page_number, node_id).

    ``pages``: (material_id, page_number, extraction_method, content), and where they
    are there quality, content_type and block_no (the place of several blocks of a
    page). Blocks of text are units by paragraph, a TABLE is one unit.
    """
    has = pages.columns
    kind = F.coalesce("content_type", F.lit("TEXT")) if "content_type" in has else F.lit("TEXT")
    key = F.struct(
        "material_id", "page_number", (F.col("block_no").cast("long") if "block_no" in has else F.lit(0).cast("long")).alias("block_no"), "extraction_method",
        kind.alias("content_type"), (F.col("quality") if "quality" in has else F.lit(None).cast("string")).alias("quality"),
    )
    keyed = pages.select(key.alias("k"), "content")
    text = paragraphs(keyed.where("k.content_type <> 'TABLE'"), "k", "content").select("k.*", "paragraph_no", F.col("paragraph").alias("text"))
    tables = keyed.where("k.content_type = 'TABLE'").select("k.*", F.lit(0).cast("long").alias("paragraph_no"), F.col("content").alias("text"))
    units = text.unionByName(tables).join(located, ["material_id", "page_number"], "left")
    return number_chunks(pack_chunks(units, target, hard, overlap, count, ("page_number", "block_no", "paragraph_no")))
