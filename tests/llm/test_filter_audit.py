"""The filter audit against applying every order to the documents, one by one."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from lectern.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, source string, mask int, part string, salt int"


def fails(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    return {"A": len(w) < 6, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        f = fails(text)
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)
        rows.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        table = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                now = [r for r in left if f in r[1]]
                gone = [r for r in mine if f in r[1] and not any(r is x for x in left)]
                left = [r for r in left if f not in r[1]]
                removed[f] += len(now)
                table[part, order, k + 1] = [len(left), len(now), len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in now), sum(r[3] for r in now)]
        out |= {key: (*v, removed[key[1][key[2] - 1]]) for key, v in table.items()}
    return out


def got(spark, docs, labels):
    df = filter_audit.audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), min_words=6)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_applying_every_order(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "b", "Cc", "d#", "e", "é", "F"]) for _ in range(rnd.randrange(12))) for _ in range(40)] + [None, "", " \t\n", "x" * 50_000 + " y"]
    docs = [(rnd.randrange(200), rnd.choice(texts), rnd.choice(["s", "t", None, ""]), 1, "p", 2) for _ in range(150)]
    docs += [(500 + k, "one text that many share", "hot", None, None, None) for k in range(300)]
    docs += [docs[0], docs[0], (None, texts[3], "s", 0, None, 0), (None, "one text that many share", "hot", 0, None, 0), (-5, "", "s", 0, None, 0)]
    labels = [(rnd.choice([None, *range(220), 501, 502]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(150)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_audit_of_small_tables(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    one = [(3, None, None, 0, "x", 0)]
    assert got(spark, one, []) == brute(one, []) and len(got(spark, one, [])) == 600


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """The join compares the texts themselves: rows whose hashes agree by chance are no copies."""
    rows = spark.createDataFrame([("p", k, 7, t) for k, t in enumerate(["a", "b", "a", "c", "b"])], "part string, id long, h long, text string")
    made = []
    assert sorted(r.id for r in filter_audit.later_copies(rows, made).collect()) == [2, 4]


def test_a_large_group_of_copies_is_joined_in_parts(spark):
    rows = spark.range(5_000).select(F.lit("p").alias("part"), "id", F.lit(1).cast("long").alias("h"), F.lit("same").alias("text"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(filter_audit.SALTS)).cast("int"))
    assert filter_audit._present_salts(salted, ["h"], where="n > 1").count() > 900
    assert filter_audit.later_copies(rows, []).count() == 4_999
