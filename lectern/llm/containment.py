"""Benchmark decontamination: size-partitioned MinHash containment search.

The test items are partitioned by size. Those of up to ``SMALLEST`` shingles are
looked up exactly: a document that holds enough of an item holds one of any
n - need + 1 of its n shingles, so these, the rarest among the items first, are
keys for every shingle of the document. For the others a document is cut, for each partition,
into overlapping windows of twice the partition's upper size, so that an item
and the window that holds it have a Jaccard similarity of useful size however
long the document is. An item is a candidate of a document if one of
``N_HASH`` minima of some window equals the item's; window minima for larger
partitions are minima of smaller blocks' minima, so each word is hashed once.
Candidates are verified: shared distinct shingles over the item's shingles,
counted over the whole document.

The items are the query set. They are broadcast in blocks of at most
``block_items`` items and some ``block_bytes`` of text, which their size is
counted for first (a block takes eight times its text, 200 MB); a larger
benchmark takes several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textkit import chunks, distinct_by_row, minima, mix, multipliers, ragged, shingles_of, utf8

N_HASH = 48
#: Shingles in the smallest block, and the most of an item looked up exactly; the other partitions hold items of up to 32, 64, ... shingles.
SMALLEST = 16
_SEEDS = multipliers(N_HASH, 11)
_LOW = np.uint64((1 << 20) - 1)


class ItemBlock:
    """Items by partition: their minima, and their distinct shingles for verification."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        buf, off = utf8(pa.array(texts, pa.string()))
        values, bounds = distinct_by_row(*shingles_of(buf, off))
        self.ids = np.array(ids, np.int64)
        self.values, self.bounds = values, bounds
        sizes = np.diff(bounds)
        level = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1) / SMALLEST)).clip(0), -1).astype(int)
        short = np.flatnonzero(level == 0)
        of = np.repeat(short, sizes[short])
        flat = values[ragged(bounds[:-1][short], sizes[short])]
        _, inverse, often = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((flat, often[inverse], of))  # an item's shingles, the rarest first
        flat, of = flat[order], of[order]
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes[short]) - sizes[short], sizes[short])
        order = np.argsort(flat, kind="stable")
        self.short = flat[order], of[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)  # most shingles of a document are in no item
        self.maybe[flat & _LOW] = True
        self.partitions = []
        for k in sorted(set(level[level > 0].tolist())):
            items = np.flatnonzero(level == k)
            flat = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in items])
            cuts = np.concatenate([[0], np.cumsum(sizes[items])[:-1]])
            m = mix(minima(flat, cuts, _SEEDS) + _SEEDS)  # the hash function's number is part of the key
            order = np.argsort(m.ravel(), kind="stable")
            self.partitions.append((k, m.ravel()[order], np.repeat(items, N_HASH)[order]))

    def search(self, values: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, int, int]]:
        """(row, item, shared shingles, item's shingles) of the rows that hold enough of an item."""
        found: set[tuple[int, int]] = set()
        if len(values) and len(self.short[0]):
            self._look_up(values, bounds, threshold, found)
        if len(values) and self.partitions:
            self._meet(values, bounds, found)
        out = []
        by_row: dict[int, list[int]] = {}
        for r, i in sorted(found):
            by_row.setdefault(r, []).append(i)
        for r, items in by_row.items():
            mine = np.unique(values[bounds[r] : bounds[r + 1]])
            for i in items:
                want = self.values[self.bounds[i] : self.bounds[i + 1]]
                shared = int(np.isin(want, mine, assume_unique=True).sum())
                if shared >= threshold * len(want):
                    out.append((r, i, shared, len(want)))
        return out

    def _look_up(self, values: np.ndarray, bounds: np.ndarray, threshold: float, found: set[tuple[int, int]]) -> None:
        """Adds the candidates (row, item) among the short items: those with one of the shingles that can't all be missing."""
        keys, owners, place = self.short
        n = np.diff(self.bounds)[owners]
        lead = place <= n - np.maximum(np.ceil(threshold * n - 1e-9), 1)
        keys, owners = keys[lead], owners[lead]
        at = np.flatnonzero(self.maybe[values & _LOW])
        lo, hi = np.searchsorted(keys, values[at], "left"), np.searchsorted(keys, values[at], "right")
        hit = np.flatnonzero(hi > lo)
        row = np.searchsorted(bounds, at[hit], "right") - 1
        pairs = np.unique(np.stack([np.repeat(row, (hi - lo)[hit]), owners[ragged(lo[hit], (hi - lo)[hit])]]), axis=1)
        found.update(zip(*pairs.tolist()))

    def _meet(self, values: np.ndarray, bounds: np.ndarray, found: set[tuple[int, int]]) -> None:
        """Adds the candidates (row, item) of the other partitions: those with a minimum in common with some window."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // SMALLEST)
        row = np.repeat(np.arange(len(sizes)), blocks)
        upto = np.concatenate([[0], np.cumsum(blocks)])
        low = minima(values, bounds[:-1][row] + (np.arange(len(row)) - upto[:-1][row]) * SMALLEST, _SEEDS)
        level, at = 0, np.arange(len(row)) - upto[:-1][row]
        for k, keys, owners in self.partitions:
            while level < k:  # blocks twice as long, from pairs
                first = np.flatnonzero(at % 2 == 0)
                second = np.minimum(first + 1, len(row) - 1)
                pair = (row[second] == row[first]) & (second > first)
                low = np.where(pair[:, None], np.minimum(low[first], low[second]), low[first])
                row, at, level = row[first], at[first] // 2, level + 1
            window = low.copy()  # a block and the one after it
            same = row[1:] == row[:-1]
            window[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
            m = mix(window + _SEEDS).ravel()
            lo = np.searchsorted(keys, m, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == m)
            hi = np.searchsorted(keys, m[hit], "right")
            for h, a, b in zip(hit.tolist(), lo[hit].tolist(), hi.tolist()):
                found.update((int(row[h // N_HASH]), int(i)) for i in owners[a:b])


def _passes(items: DataFrame, block_items: int, block_bytes: int) -> int:
    """In how many blocks items of such number and size go out."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-n // block_items), -(-size // block_bytes))


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_items: int = 100_000, block_bytes: int = 25_000_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): documents that hold ``threshold`` or more of an item's shingles.

    Texts are lower-cased in A-Z and split at spaces and the bytes 9 to 13; an
    item of fewer than five words is one shingle, found only in a document of
    just these words. Null or empty items and documents match nothing. Repeated
    documents and items give repeated rows; of items with a null id only the text
    counts. Equal items go out once with their number, so blocks by a hash are
    even, whatever repeats.
    Documents stay where they are: no shuffle, no pairs beyond the matches.
    """
    spark = docs.sparkSession
    numbered = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    numbered = numbered.groupBy("id", "text").agg(F.count("*").alias("n"))
    passes = _passes(numbered, block_items, block_bytes)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for p in range(passes):
        block = numbered if passes == 1 else numbered.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == p)
        rows = sorted(block.collect(), key=lambda r: (r.id is not None, r.id or 0, r.text))
        shared = spark.sparkContext.broadcast(ItemBlock([r.id or 0 for r in rows], [r.text for r in rows]))
        nulls = frozenset(i for i, r in enumerate(rows) if r.id is None)
        times = np.array([r.n for r in rows], np.int64)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, nulls=nulls, times=times) -> Iterator[pa.RecordBatch]:
            for b in batches:
                buf, off = utf8(b.column(1))
                for lo, hi in chunks(off):
                    hits = shared.value.search(*shingles_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), threshold)
                    if hits:
                        r, i, s, k = map(list, zip(*hits))
                        ids = shared.value.ids[i]
                        yield pa.record_batch(
                            [b.column(0).take(pa.array([lo + x for x in r])), pa.array(ids, pa.int64(), mask=np.array([x in nulls for x in i])), pa.array(s, pa.int64()), pa.array(k, pa.int64()), pa.array(times[i])],
                            ["doc_id", "item_id", "shared", "item_shingles", "n"],
                        )

        found = source.mapInArrow(run, "doc_id long, item_id long, shared long, item_shingles long, n long")
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", "item_id", "shared", "item_shingles", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def op6_containment(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM texts WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(z.n) AS item_shingles
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.75 * any_value(z.n)
"""


def without_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.75, text_col: str = "text", item_text: str = "text", block_items: int = 100_000, block_bytes: int = 25_000_000) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled.

    The rules are those of ``find_contained``; null and empty texts stay.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    passes = _passes(texts, block_items, block_bytes)
    place, schema = docs.columns.index(text_col), docs.schema
    for p in range(passes):
        block = texts if passes == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == p)
        rows = sorted(r.text for r in block.collect())
        shared = spark.sparkContext.broadcast(ItemBlock([*range(len(rows))], rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                buf, off = utf8(b.column(place))
                for lo, hi in chunks(off):
                    hits = shared.value.search(*shingles_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), threshold)
                    keep = np.ones(hi - lo, bool)
                    keep[[h[0] for h in hits]] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; all columns stay as they were.

    Null and empty texts hold none and stay; repeated rows are judged alike. Without
    items, or with null and blank ones only, all documents stay.
    """
    return without_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
