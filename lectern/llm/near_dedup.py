"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``HALVES`` half-keys of two minima each are computed;
a table key joins one half-key of either collection, so HALVES**2 tables come
from 4 * HALVES minima. Two texts that meet in a table share a left and a right
half; at a similarity of 0.75 a pair meets nowhere with a probability below
2 * (1 - 0.75**2)**HALVES, 1 in 10,000. Equal shingle sets are taken together first.

The texts that meet, directly or by others, form a family. Texts are compared
exactly, on full shingle sets: a task gets a group of bounded size, multiplies
presence matrices, and returns labels of linked texts, never pairs. A family of
one block is one group. In a larger one

1. each text is compared with its anchors, the smallest texts of the table
   buckets it is in, and with the texts of one block around each anchor;
2. the texts that an anchor's block doesn't link with it meet, block by block,
   each other and those that are linked; the linked ones don't meet again.

Copies of one text, however alike, are so read as often as they have different
anchors, at most HALVES**2 times, not once for each block of their bucket. The
components of all labels are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.llm.shared import discard, free_names, stored
from lectern.llm.textkit import chunks, distinct_by_row, minima, mix, multipliers, shingles_of, utf8

HALVES = 12
_FACTORS = multipliers(4 * HALVES, 23)
#: Bounds of a block of a family: texts, and shingles of all of them.
BLOCK_TEXTS, BLOCK_SHINGLES = 500, 500_000
SALTS = 32


def _half_keys(low: np.ndarray) -> np.ndarray:
    """(n, 2 * HALVES) half-keys from (n, 4 * HALVES) minima; the side and number are part of each."""
    with np.errstate(over="ignore"):
        first, second = low[:, 0::2], low[:, 1::2]
        return mix(mix(first + np.arange(1, 2 * HALVES + 1, dtype=np.uint64)) ^ second)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, halves); equal shingle sets have equal fp1 and fp2, 128 bits together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8(b.column(1))
            for lo, hi in chunks(off):
                values, bounds = distinct_by_row(*shingles_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                fp = np.zeros((2, len(n)), np.uint64)
                halves = np.zeros((len(some), 2 * HALVES), np.uint64)
                if len(some):
                    with np.errstate(over="ignore"):
                        fp[0, some] = np.add.reduceat(values, bounds[some])
                        fp[1, some] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[some])
                    halves = _half_keys(minima(values, bounds[some], _FACTORS))
                size = np.where(n > 0, 2 * HALVES, 0)
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(halves.ravel().view(np.int64)))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), rows], ["doc_id", "n_shingles", "fp1", "fp2", "halves"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, halves array<long>")


def _salt(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def _spread(rows: DataFrame, keys: list[str], *aggregates, where: str) -> DataFrame:
    """Aggregates of the groups of ``rows``, a row for each salt that the group has, to be joined by keys and salt.

    A large group is added up, and joined, in up to SALTS parts; a small one costs no more rows than it has.
    """
    parts = rows.groupBy(*keys, "salt").agg(F.count("*").alias("n"), *(f(c).alias(name) for f, c, name in aggregates))
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"), *(f(name).alias(name) for f, _, name in aggregates))
    return whole.where(where).select(*keys, *(name for *_, name in aggregates), F.explode("salts").alias("salt"))


def table_keys(texts: DataFrame, made: list[str]) -> DataFrame:
    """(rep, key, salt) of each text's table keys; input (rep, halves).

    Half-keys that only one text has are left out before any table key is made,
    so unlike texts cost 2 * HALVES rows, not HALVES**2.
    """
    halves = texts.select("rep", F.posexplode("halves").alias("place", "half")).withColumn("salt", _salt("rep"))
    live = halves.join(_spread(halves, ["half"], where="n > 1"), ["half", "salt"], "left_semi")
    sides = live.groupBy("rep").agg(
        F.collect_set(F.when(F.col("place") < HALVES, F.col("half"))).alias("left"),
        F.collect_set(F.when(F.col("place") >= HALVES, F.col("half"))).alias("right"),
    )
    keys = sides.select("rep", "right", F.explode("left").alias("l")).select("rep", "l", F.explode("right").alias("r")).select("rep", F.xxhash64("l", "r").alias("key"))
    return stored(keys.withColumn("salt", _salt("rep")), "table-keys", made)


def meetings(keys: DataFrame) -> DataFrame:
    """(a, b): each text of a table bucket and the bucket's smallest text."""
    lowest = _spread(keys, ["key"], (F.min, "rep", "a"), where="n > 1")
    return keys.join(lowest, ["key", "salt"]).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def _linked(values: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest position of the sets it is linked with, over any number of links."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(n), sizes)
    distinct, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    col, row = number[inverse[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    shared = np.zeros((n, n), np.float32)
    width = 4_096
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        x = np.zeros((n, width), np.float32)
        x[row[lo:hi], col[lo:hi] - c] = 1
        used = np.flatnonzero(x.any(1))
        part = x[used]
        shared[np.ix_(used, used)] += part @ part.T
    both = sizes[:, None] + sizes[None, :] - shared
    link = 100 * shared >= percent * both
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(1)
        low = np.minimum(low[low], low)
        if (low == label).all():
            return label
        label = low


def _blocks(count: str, weight: str):
    return F.greatest(F.ceil(F.col(count) / BLOCK_TEXTS), F.ceil(F.col(weight) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def with_blocks(rows: DataFrame, of: str, rep: str = "rep") -> DataFrame:
    """The rows with the number of blocks that the texts ``rep`` of each ``of`` fill."""
    rows = rows.withColumn("salt", _salt(rep)).withColumn("one", F.lit(1))
    sizes = _spread(rows, [of], (F.sum, "one", "count"), (F.sum, "n_shingles", "weight"), where="true")
    return rows.join(sizes.select(of, "salt", _blocks("count", "weight").alias("blocks")), [of, "salt"]).drop("one", "salt")


def around_anchors(meets: DataFrame) -> DataFrame:
    """(group, rep): each anchor with a block of the texts that it meets; input (a, b, n_shingles), a the anchor."""
    dealt = with_blocks(meets, "a", "b").withColumn("group", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))))
    return dealt.select("group", F.explode(F.array("a", "b")).alias("rep")).distinct()


def apart_from_anchors(meets: DataFrame, near: DataFrame) -> DataFrame:
    """(group, rep) for anchors that aren't linked with all they meet; input (a, b, n_shingles), and links (a, b) found.

    Every two texts that meet one anchor share a group, unless both are linked
    with it already.
    """
    rows = meets.join(near.select("a", "b", F.lit(True).alias("linked")).distinct(), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    one, size = F.lit(1), F.col("n_shingles")
    for name, value in (("in_n", one), ("in_w", size)):
        rows = rows.withColumn(name, F.when(F.col("linked"), value).otherwise(0)).withColumn(name.replace("in", "all"), value)
    rows = rows.withColumn("salt", _salt("b"))
    sums = [(F.sum, name, name) for name in ("in_n", "in_w", "all_n", "all_w")]
    sums = _spread(rows, ["a"], *sums, where="in_n < all_n and all_n > 1").withColumns({"out_n": F.expr("all_n - in_n"), "out_w": F.expr("all_w - in_w")})
    mixed = sums.select("a", "salt", (_blocks("all_n", "all_w") == 1).alias("whole"), _blocks("in_n", "in_w").alias("inside"), _blocks("out_n", "out_w").alias("outside"))
    dealt = rows.select("a", "b", "linked", "salt").join(mixed, ["a", "salt"])
    dealt = dealt.withColumn("place", F.pmod(F.xxhash64("b"), F.when(F.col("linked"), F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    key, place = F.col("a"), F.col("place")
    ins, outs = F.sequence(F.lit(0), F.col("inside") - 1), F.sequence(F.lit(0), F.col("outside") - 1)
    groups = (
        F.when(F.col("whole"), F.array(F.xxhash64(key, F.lit("all"))))
        .when(F.col("linked"), F.transform(outs, lambda j: F.xxhash64(key, F.lit("in"), j, place)))
        .otherwise(
            F.concat(
                F.transform(ins, lambda j: F.xxhash64(key, F.lit("in"), place, j)),
                F.transform(F.filter(outs, lambda j: j != place), lambda j: F.xxhash64(key, F.lit("out"), F.least(place, j), F.greatest(place, j))),
            )
        )
    )
    return dealt.select(F.explode(groups).alias("group"), F.col("b").alias("rep"))


def links_of_large(large: DataFrame, meets: DataFrame, texts: DataFrame, percent: int, made: list[str]) -> DataFrame:
    """(a, b) links that join what is linked in families of more than one block; ``large``: (rep, n_shingles)."""
    texts = stored(texts.join(large.select("rep"), "rep", "left_semi"), "large-texts", made)
    meets = meets.join(large.withColumnRenamed("rep", "b"), "b").select("a", "b", "n_shingles")
    near = stored(compare(around_anchors(meets), texts, percent), "anchored", made)
    return near.unionByName(compare(apart_from_anchors(meets, near), texts, percent))


def compare(groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join all texts of a group that are linked; ``groups``: (group, rep), ``texts``: (rep, text)."""
    tasks = groups.join(texts, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; groups are compared as they end."""
        held: list[pa.RecordBatch] = []
        current = None

        def judged():
            table = pa.Table.from_batches(held).combine_chunks()
            rep = np.asarray(table.column("rep"))
            _, once = np.unique(rep, return_index=True)  # a repeated id has one text here
            rep, texts = rep[once], table.column("text").take(pa.array(once))
            buf, off = utf8(texts)
            label = _linked(*distinct_by_row(*shingles_of(buf, off)), percent)
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.record_batch([pa.array(rep[label[far]]), pa.array(rep[far])], ["a", "b"])

        for b in batches:
            groups = np.asarray(b.column("group"))
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if current is not None and groups[lo] != current:
                    yield judged()
                    held = []
                current = groups[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield judged()

    rows = tasks.select("group", "rep", "text").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Null texts and texts without a word have no shingles and are linked with
    nothing; texts of fewer than five words are one shingle. Rows with the same id
    are expected to have the same text. A row with a null id can't be named: its
    component is null and it is kept. Other columns are ignored.
    """
    made: list[str] = []
    rows = stored(signatures(docs, id_col, text_col), "signatures", made)
    named = rows.where("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("n_shingles").alias("n_shingles"))
    sets = stored(sets, "sets", made)
    texts = named.withColumnRenamed("doc_id", "rep").join(sets.select("rep"), "rep", "left_semi").select("rep", "halves").dropDuplicates(["rep"])
    meets = stored(meetings(table_keys(texts, made)), "meets", made)
    families = components(meets, made=made).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    members = stored(families.join(sets.select("rep", "n_shingles"), "rep"), "members", made)
    sized = with_blocks(members, "family")
    whole = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    links = compare(sized.where("blocks = 1").select(F.xxhash64("family").alias("group"), "rep"), whole, percent)
    large = stored(sized.where("blocks > 1").select("rep", "n_shingles"), "large", made)
    if not large.isEmpty():
        links = links.unionByName(links_of_large(large, meets, whole, percent, made))
    roots = components(links, made=made).select(F.col("node").alias("rep"), "root")
    named_sets = sets.join(roots, "rep", "left").where("n > 1 or root is not null").select("fp1", "fp2", F.coalesce("root", "rep").alias("component"))
    # a set of many rows is joined in parts, like the groups above
    salted = rows.withColumn("salt", _salt("doc_id"))
    many = _spread(salted.where("n_shingles > 0"), ["fp1", "fp2"], where="true").join(named_sets, ["fp1", "fp2"])
    out = salted.join(many, ["fp1", "fp2", "salt"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    result = stored(result, "near-duplicates")
    discard(docs.sparkSession, made)
    return result


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.other) AS component_id, min(r.other) = d.doc_id AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes z USING (doc_id) GROUP BY d.doc_id
"""


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns stay as they were.

    Texts that are null or have no word are linked with nothing and stay, as do
    rows with a null id. Of several rows with one id one stays (that whose text
    has the smallest hash). An empty table gives no rows.
    """
    name, place = free_names(docs, "gone", "place")
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    # the texts are dealt by id once, at every size; copies of a row are then side by side
    left = docs.where("doc_id is not null").join(gone.hint("merge"), docs["doc_id"] == F.col(name), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce(F.xxhash64("text"), F.lit(0))))
    return left.withColumn(place, first).where(F.col(place) == 1).drop(place).unionByName(docs.where("doc_id is null"))
