"""Filter interaction audit: what each filter removes alone, after others and in every order.

Five conditions fail a document: A too few words, B too few distinct words, C too
many capitals, D special signs, E a smaller id has the same text. E is an
existential self-join: a left-semi join on hash, exact text and smaller id. Its
ids are united with those that fail another filter, each document gets the
combination of its failures as five bits, and the combinations are counted by
part and label. These counts (at most 32 * 4 a part) hold all that the orders of
four filters and E need, so no order is ever applied to documents. Only DataFrame
functions are used.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, stored

FILTERS = "ABCDE"
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
_SPACE = "[\\x20\\x09-\\x0D]+"
#: Sub-keys of one hash; a hash uses as many as it has rows, up to this number.
SALTS = 1024


def failures(text: Column, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, signs: str = "[#$%&*|]") -> Column:
    """The bits of the conditions A to D of a text."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    bit = lambda name, fails: F.when(fails, _BIT[name]).otherwise(0)
    return (
        bit("A", n < min_words)
        + bit("B", 100 * distinct < distinct_percent * n)
        + bit("C", 100 * F.regexp_count(text, F.lit("[A-Z]")) > capital_percent * F.length(text))
        + bit("D", text.rlike(signs))
    )


def _present_salts(rows: DataFrame, keys: list[str], *aggregates: Column, where: str = "true") -> DataFrame:
    """(keys, aggregates, salt): a row for each salt that a group has, so that a large group is joined in many parts and a small one costs no more rows than it has."""
    parts = rows.groupBy(*keys, "salt").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    return whole.where(where).select(*keys, *aggregates, F.explode("salts").alias("salt"))


def later_copies(rows: DataFrame, made: list[str]) -> DataFrame:
    """The rows of (part, id, h, text) whose text some smaller id has.

    Only hashes of more than one row are joined by their texts. A null id is
    smaller than none and has no smaller one.
    """
    salted = rows.where("id is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    shared = _present_salts(salted.select("h", "id", "salt"), ["h"], where="n > 1")
    twins = stored(salted.join(shared.hint("merge"), ["h", "salt"], "left_semi"), "audit-twins", made)
    firsts = _present_salts(twins, ["h", "text"], F.col("first"), where="n > 1").hint("merge")
    same = (twins["h"] == firsts["h"]) & (twins["salt"] == firsts["salt"]) & (twins["text"] == firsts["text"])
    return twins.join(firsts, same & (firsts["first"] < twins["id"]), "left_semi").drop("salt")


def combinations(docs: DataFrame, labels: DataFrame, made: list[str], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **bounds) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part with just these failures and labels."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    key = ["part", "id", "h", "g"]  # a repeated id with another text is another document
    other = F.xxhash64(F.lit(1), "text").alias("g")
    failing = rows.select("part", "id", "h", other, failures(F.col("text"), **bounds).alias("bits"), F.lit(1).cast("long").alias("n"))
    copies = later_copies(rows, made).select("part", "id", "h", other, F.lit(_BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    each = failing.unionByName(copies).groupBy(*key).agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))
    counted = each.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    label = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null").groupBy("id")
    label = label.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = counted.join(label.hint("merge"), "id", "left").select("part", "mask", "n", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    return known.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(order), k + 1, _BIT[f], before))
            before |= _BIT[f]
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **bounds) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    600 rows a part, one for each order of the filters and step. Null texts are
    empty and a null part is the empty one. Rows with the same id and text are
    repeated documents, counted each, none a copy of the other; a row with a null
    id has no label, is never a later copy and makes none. An id with several
    label rows is good, or toxic, if one of them says so. Other columns are
    ignored; an empty table has no part and gives no rows.

    A filter after the set S of others removes what fails it and none of S, so 80
    pairs of filter and S stand for all 600 steps, and a pair occurs in
    |S|! * (4 - |S|)! orders.
    """
    made: list[str] = []
    counts = stored(combinations(docs, labels, made, id_col, text_col, part_col, **bounds), "audit-combinations", made)
    discard(docs.sparkSession, made[:-1])
    orders = _orders()
    pairs = sorted({(bit, before) for *_, bit, before in orders})
    ways = [factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count()) for _, before in pairs]
    literal = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before"), F.lit(w).alias("ways")) for (b, s), w in zip(pairs, ways)])
    each = counts.select("*", F.explode(literal).alias("p")).select("*", "p.*")
    mask, bit, before, n = F.col("mask"), F.col("bit"), F.col("before"), F.col("n")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda what: F.sum(F.when(what, n).otherwise(0)).cast("long")
    steps = each.groupBy("part", "bit", "before", "ways").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~earlier & F.col("good")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = steps.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("ways")).cast("long").alias("shapley"))
    table = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, bit int, before int")  # always 600 rows
    out = steps.join(shapley, ["part", "bit"]).join(F.broadcast(table), ["bit", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents, by source, with their labels."""
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), good AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END) AS mask
  FROM worded LEFT JOIN good USING (doc_id)
), counts AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM judged GROUP BY ALL
), letters AS (
  SELECT chr((65 + k)::INT) AS f, (1 << k)::INT AS bit FROM range(5) t(k)
), prefixes(filter_order, step, bit, before, done) AS (
  SELECT f, 1, bit, 0, bit FROM letters
  UNION ALL SELECT filter_order || f, step + 1, l.bit, done, done | l.bit FROM prefixes p JOIN letters l ON (p.done & l.bit) = 0
), orders AS (
  SELECT o.filter_order, p.step, p.bit, p.before FROM prefixes o JOIN prefixes p ON starts_with(o.filter_order, p.filter_order) WHERE o.step = 5
), steps AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((mask & (bit | before)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) = 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM counts CROSS JOIN orders GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM steps
"""
