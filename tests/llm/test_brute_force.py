"""Operators whose rows SQL can't express, against plain versions, and the registered queries on the smallest tables."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe_automaton, language_id, near_dedup, pitman_yor, png_media, queries, rans_tokens

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


# ---- scoring


class Restaurants:
    """The model by the book: one customer moves at a time, tables have sizes, every seat counts at once."""

    def __init__(self, discounts, vocabulary, rng):
        self.d, self.base, self.rng = discounts, 1 / (vocabulary + 1), rng
        self.tables = defaultdict(lambda: defaultdict(list))
        self.customers, self.opened = defaultdict(int), defaultdict(int)

    def chance(self, context, word):
        if context is None:
            return self.base
        parent = context[1:] if context else None
        mine = self.tables[context][word] if word in self.tables[context] else []
        d = self.d[len(context)]
        return (sum(mine) - d * len(mine) + (1 + d * self.opened[context]) * self.chance(parent, word)) / (1 + self.customers[context])

    def add(self, context, word):
        if context is None:
            return
        parent, d, mine = context[1:] if context else None, self.d[len(context)], self.tables[context][word]
        weights = [n - d for n in mine] + [(1 + d * self.opened[context]) * self.chance(parent, word)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(mine):
            mine.append(0)
            self.opened[context] += 1
            self.add(parent, word)
        mine[k] += 1
        self.customers[context] += 1

    def remove(self, context, word):
        if context is None:
            return
        mine = self.tables[context][word]
        k = self.rng.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        self.customers[context] -= 1
        if not mine[k]:
            del mine[k]
            self.opened[context] -= 1
            self.remove(context[1:] if context else None, word)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def steps(text):
    words = [*WORDS.findall(ascii_lower(text)), "</s>"]
    before = ("<s>", "<s>")
    for w in words:
        yield before, w
        before = (before[1], w)


def test_scores_equal_a_sampler_of_single_customers(spark):
    rng = random.Random(7)
    follow = {a: rng.sample("abcdefghijkl", 3) for a in "abcdefghijkl"}
    docs = []
    for i in range(260):
        w = [rng.choice("abcdefghijkl")]
        while len(w) < 12:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.8 else rng.choice("abcdefghijkl"))
        docs.append((i, " ".join(w)))
    docs += [(1_000 + i, "a rare sentence stands here twice zz") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = pitman_yor.PitmanYorModel(df, rounds=14, burn_in=4, shard_tokens=900)
    got = {r.doc_id: r for r in model.scores().collect()}
    d1, d2, d3 = model.d1, model.d2, model.d3
    vocabulary = model.vocabulary
    model.close()
    train = [(c, w) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for c, w in steps(t)]
    plain = Restaurants((d1, d2, d3), vocabulary, rng)
    for c, w in train:
        plain.add(c, w)
    mean, taken = defaultdict(float), 0
    for sweep in range(40):
        for c, w in train:
            plain.remove(c, w)
            plain.add(c, w)
        if sweep >= 15:
            taken += 1
            for i, t in docs:
                for k, (c, w) in enumerate(steps(t)):
                    mean[i, k] += plain.chance(c, w)
    for i, t in docs:
        want = sum(math.log10(mean[i, k] / taken) for k in range(len(list(steps(t)))))
        assert abs(got[i].score / want - 1) < 0.03, (i, got[i].score, want)
        assert abs(got[i].perplexity - 10 ** (-got[i].score / got[i].n_tokens)) < 1e-6 * got[i].perplexity


# ---- media


def plain_hash(img):
    """The cosine transform written out, on the means of a 32 x 32 grid."""
    rows, cols = img.shape
    edges = lambda n: [(i * n // 32, (i + 1) * n // 32 if n >= 32 else i * n // 32 + 1) for i in range(32)]
    cell = np.array([[img[a:b, c:d].mean() for c, d in edges(cols)] for a, b in edges(rows)])
    cos = [[math.cos(math.pi / 32 * (x + 0.5) * k) for x in range(32)] for k in range(8)]
    low = [round(float(sum(cos[u][y] * cos[v][x] * cell[y, x] for y in range(32) for x in range(32))), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return "".join(f"{int(''.join('1' if x > middle else '0' for x in low[i : i + 8]), 2):02x}" for i in range(0, 64, 8))


@tables
def test_media_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op9_png_media"](spark, SF).collect()
    assert len(got) == len(texts)
    for k, r in enumerate(got):
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        png = png_media.png_of(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        if k % 10 == 0:
            assert r.feature == plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float))
        # the stored form, chunk by chunk, by the standard library alone
        at, data = 8, b""
        while at < len(png):
            n, kind = struct.unpack(">I4s", png[at : at + 8])
            assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(png[at + 4 : at + 8 + n])
            data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        assert len(zlib.decompress(data)) == len(payload) // 64 * 65


# ---- tokens


@tables
def test_token_queries(spark):
    lib = pytest.importorskip("tokenizers").Tokenizer
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    word, byte = lib.from_file(bpe_automaton.default_path()), lib.from_file(rans_tokens.default_path())
    for t in (word, byte):
        t.no_truncation()
        t.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.QUERIES["op7_bpe_automaton"](spark, SF).collect():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(word.decode(ids, skip_special_tokens=False))
    got, start = sorted(queries.QUERIES["op8_rans_tokens"](spark, SF).collect(), key=lambda r: r.start), 0
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        ids = byte.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


# ---- language


def plain_grams(text, n):
    t = "".join("0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else (c.lower() if len(c.lower()) == 1 else c) for c in text)
    return {t[i : i + n] for i in range(len(t) - n + 1)}


@lru_cache(maxsize=None)
def plain_sets(text):
    return [plain_grams(text, n) for n in (1, 2, 3)]


def plain_kernel(a, b):
    out = 0.0
    for x, y in zip(plain_sets(a), plain_sets(b)):
        out += len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0
    return out / 3


class PlainModel:
    """Nyström features of the landmarks and one ridge regression a language, by dense algebra on plain sets."""

    def __init__(self, picked, landmarks):
        """``picked``: sorted (language, rank, text)."""
        self.marks = [t for _, k, t in picked if k <= landmarks]
        k = np.array([[plain_kernel(t, m) for m in self.marks] for _, _, t in picked])
        own = np.array([[plain_kernel(a, b) for b in self.marks] for a in self.marks])
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * values.max()
        lift = vectors[:, good] / np.sqrt(values[good])
        self.langs = sorted({p[0] for p in picked})
        y = np.array([[1.0 if lang == x else -1.0 for x in self.langs] for lang, _, _ in picked])
        size = np.array([[1 / sum(p[0] == lang for p in picked)] for lang, _, _ in picked])
        phi = k @ lift
        self.w = lift @ np.linalg.solve(phi.T @ (size * phi) + 1e-3 * np.eye(phi.shape[1]), phi.T @ (size * y))

    def shares(self, text):
        margin = 4 * np.array([plain_kernel(text, m) for m in self.marks]) @ self.w
        p = np.exp(margin - margin.max())
        return p / p.sum()


def test_kernel_ridge_equals_the_plain_form(spark):
    rng = random.Random(5)
    stems = {"en": ["the", "ing", "and", "th"], "fr": ["que", "é", "le", "eau"], "de": ["sch", "ü", "der", "ung"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate(rng.choice([*stems]) for _ in range(90))]
    rows += [(90, "the the", "en"), (91, "the the", "en"), (92, "le 12 Ünd", None), (93, "the\tÉ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, per_lang=20, landmarks_per_lang=6)
    picked = sorted((r.lang, r["rank"], r.text) for r in language_id.training_sample(df, "doc_id", "text", "lang", 20, 200, 20_000).collect())
    plain = PlainModel(picked, 6)
    for r in language_id.identify(df, model).collect():
        p = plain.shares(r.text)
        assert abs(r.lang_score - p.max()) < 2e-3 and (plain.langs[int(p.argmax())] == r.lang_pred or np.sort(p)[-2] > 0.99 * p.max())
    twins = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify(df.where("doc_id in (90, 91)"), model).collect()}
    assert twins[90] == twins[91]


@tables
def test_language_query(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op10_language_id"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id].text or ""))
    held = [r for r in got if r.held_out and rows[r.doc_id].lang]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.95 * len(held)


# ---- the registered queries


@tables
def test_scoring_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toks = {i: [w for _, w in steps(t)] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = defaultdict(int)
    for i in texts:
        for w in () if held[i] else toks[i]:
            count[w] += 1
    n, v = sum(count.values()), len(count)
    got = queries.QUERIES["op1_pitman_yor"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(toks[r.doc_id]), n)
        assert r.n_known == sum(w in count for w in toks[r.doc_id])
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > 1.02 * sum(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in toks[r.doc_id]) for r in unseen)


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda df: sorted(tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in df[cols].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


# ---- the pipeline


def test_language_stage(spark):
    schema = "doc_id long, text string, lang string, __lang_score string"
    rng = random.Random(2)
    stems = {"en": ["the", "ing", "and", "th"], "fr": ["que", "é", "le", "eau"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(15)), k, "x") for i, k in enumerate(rng.choice([*stems]) for _ in range(60))]
    odd = [(100, None, "en", None), (101, "", None, None), (102, "12 !?", "fr", None), (103, "zz", None, None), (104, " ".join("qxj" * 20), "en", None), (None, "the and thing", None, None), (5, rows[5][1], rows[5][2], "x")]
    df = spark.createDataFrame(rows + odd, schema).drop("__lang_score")
    out = language_id.language_stage(spark, df, "")
    assert out.columns == df.columns
    left = sorted(str(r.doc_id) for r in out.collect())
    assert {"100", "101", "102"}.isdisjoint(left) and "103" in left and "None" in left and left.count("5") == 2
    model = language_id.fit(df.where("doc_id < 60"))
    only = {r.doc_id for r in language_id.select_languages(df.where("doc_id < 60"), model, ["fr"]).collect()}
    assert only == {r[0] for r in rows if r[2] == "fr"}
    strict = {r.doc_id for r in language_id.select_languages(df, model, min_score=1.1).collect()}
    assert 103 in strict and not any(i is not None and i < 60 for i in strict)
    assert language_id.language_stage(spark, df.withColumn("lang", F.lit(None).cast("string")), "").count() == df.count()
    assert language_id.language_stage(spark, df.drop("lang"), "").count() == df.count()
    assert language_id.language_stage(spark, df.limit(0), "").count() == 0


def test_near_dedup_stage_keeps_one_row_of_an_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "a"), (3, None, "a"), (3, None, "a"), (4, "", "a"), (None, text, "a"), (None, text, "a"), (5, "alone here", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, count string")
    out = near_dedup.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "5", "None", "None"]
    assert near_dedup.near_dedup_stage(spark, df.limit(0), "").count() == 0


def test_families_too_large_are_compared_by_bucket(spark, monkeypatch):
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(80)], []
    for k in range(70):
        base[rng.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 10)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == whole


def five(text):
    w = WORDS.findall(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@tables
def test_pipeline_equals_a_plain_version(spark):
    """All five stages in plain Python give the same documents and digests."""
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: (r.text, r.source) for r in frame.collect()}
    train = frame.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    plain = PlainModel(sorted((r.lang, r["rank"], r.text) for r in language_id.training_sample(train, "doc_id", "text", "lang", 150, 200, 20_000).collect()), 16)
    letters = {i: sum(c.isalpha() for c in t or "") for i, (t, _) in docs.items()}
    docs = {i: d for i, d in docs.items() if letters[i] and (letters[i] < 20 or plain.shares(d[0]).max() >= 0.5)}
    sites, first = defaultdict(set), {}
    for i in sorted(docs):
        for p, line in enumerate((docs[i][0] or "").split("\n")):
            if bare := line.strip(" \t\r"):
                sites[bare].add(docs[i][1])
                first.setdefault(bare, (i, p))
    cut = {}
    for i, (t, _) in docs.items():
        lines = (t or "").split("\n")
        keep = [x for p, x in enumerate(lines) if not (b := x.strip(" \t\r")) or len(sites[b] - {None}) < 10 or first[b] == (i, p)]
        if len(keep) == len(lines) or "".join(keep).strip(" "):
            cut[i] = "\n".join(keep)
    sets, root = {i: five(t) for i, t in cut.items()}, {i: i for i in cut}
    for a in sorted(cut):
        for b in sorted(cut):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    items = [five(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in cut.items() if root[i] == i and not any(q and len(q & sets[i]) >= 0.75 * len(q) for q in items)}
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe_automaton.default_path())
    want = {i: hashlib.sha256(" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in left.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want
