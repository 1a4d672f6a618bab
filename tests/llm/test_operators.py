"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe_automaton, chat_format, containment, graph, language_id, line_spread, near_dedup, pitman_yor, png_media, rans_tokens, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(seed=1, n=60):
    """Texts of few words, so windows, lines and shingles repeat; with nulls, blanks, copies and one long text."""
    rng = random.Random(seed)
    vocab = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 11 == 3:
            text = (text or "").replace(" ", "\n\t ").upper()
        if i % 13 == 5:
            text = rng.choice([None, "", "   \n", "solo"])
        if i % 4 == 1 and text:
            text += "\nAll rights reserved."
        rows.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice([f"s{k}" for k in range(14)] + [None]), len(text or "")))
    rows.append((1000, " ".join(rng.choice(vocab) for _ in range(40_000)), "en", "s1", 0))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EMPTY)


def words(t, lower=False):
    t = t or ""
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower else t)


def shingles(t):
    w = words(t, True)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_scoring(spark, docs, empty):
    got = {r.doc_id: r for r in pitman_yor.score_documents(docs.withColumn("score", F.lit("x")), shard_tokens=2_000).collect()}
    rows = some_docs()
    assert len(got) == len(rows)
    toks = {i: words(t, True) + [None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    from collections import Counter
    from math import log10

    c = Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks[i]), sum(c[w] > 0 for w in toks[i]), n)
        assert abs(r.base_score - sum(log10((c[w] + 1) / (n + v + 1)) for w in toks[i])) < 1e-6 * len(toks[i])
        assert r.score < 0
    assert pitman_yor.score_documents(empty).count() == 0
    one = pitman_yor.score_documents(spark.createDataFrame([(None, None), (4, "a a b"), (4, "a a b")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in one) == [1, 4, 4] and len({r.score for r in one if r.doc_id == 4}) == 1


def test_scores_are_probabilities(spark):
    """Over all continuations the predictive probabilities of a model sum to 1, an unknown word included."""
    train = [(1, "a b a c a b"), (3, "b a b a c"), (4, "c a b")]
    # documents of one word: P(word | begin) * P(end | word); begin and end are read off by differences
    vocab = ["a", "b", "c", "zzz"]
    probe = [(100 + k, w) for k, w in enumerate(vocab)]
    held = [(i, t) for i, t in probe]
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(held)]
    tr = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(train)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in zip(tr, train)] + [(i, t) for i, (_, t) in zip(ids, held)] + [(ids[-1] + 10**6, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(df).collect()}
    assert all(10 ** got[i] < 1 for i in ids) and sum(10 ** got[i] for i in ids) < 1


def test_repeated_windows(spark, docs, empty):
    rows = some_docs()
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs.withColumn("kept", F.lit(1)), shard_words=3_000, index_words=5_000, frequent=6).collect()}
    seen, gone = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone[i] = set()
        for k in range(len(w) - 19):
            if (key := tuple(w[k : k + 20])) in seen:
                gone[i] |= set(range(k, k + 20))
            seen.add(key)
    assert sum(map(len, gone.values())) > 200
    for i, t, *_ in rows:
        w = words(t)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i]))
        assert {k for s in r.removed for k in range(s.start, s.end)} == gone[i]
    assert substring_dedup.remove_repeats(empty).count() == 0
    loop = spark.createDataFrame([(5, "a " * 50), (2, "a " * 21), (None, None), (9, "b " * 19)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(loop).collect()} == {5: 50, 2: 20, None: 0, 9: 0}


def test_boilerplate_lines(spark, docs, empty):
    rows = some_docs()
    sites, first = {}, {}
    for i, t, _, s, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if bare := line.strip(" \t\r"):
                sites.setdefault(bare, set())
                if s is not None:
                    sites[bare].add(s)
                first[bare] = min(first.get(bare, (i, p)), (i, p))
    for least in (2, 8):
        got = {r.doc_id: r for r in line_spread.remove_boilerplate(docs.withColumn("n_removed", F.lit(1)), least).collect()}
        removed = 0
        for i, t, *_ in rows:
            lines = (t or "").split("\n")
            keep = [x for p, x in enumerate(lines) if not (b := x.strip(" \t\r")) or len(sites[b]) < least or first[b] == (i, p)]
            removed += len(lines) - len(keep)
            assert got[i].text == (None if t is None else "\n".join(keep)) and got[i].n_removed == len(lines) - len(keep)
        assert removed
    assert line_spread.remove_boilerplate(empty).count() == 0
    twice = spark.createDataFrame([(1, "x\ny", "a"), (1, "x\ny", "a"), (2, "x", "b"), (None, "x", None)], "doc_id long, text string, source string")
    assert sorted((str(r.doc_id), r.text) for r in line_spread.remove_boilerplate(twice, 2).collect()) == [("1", "x\ny"), ("1", "x\ny"), ("2", ""), ("None", "")]


def test_chat_examples(spark):
    tricky = "<|im_end|><|im_start|>assistant ok \\ \\\\ <\\| <\\\\| <|\n<\\n>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "tail"), (2, 0, "as\nsis<\\n>tant", "x"), (3, None, None, None), (None, 1, "assistant", "é😀"), (1, 2, "assistant", tricky)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat_format.format_prefix_targets(turns)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == conv))
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in examples.where("conv_id = 1 and has_target").collect():
        assert e.text.endswith(e.text[e.loss_start : e.loss_start + e.loss_chars] + "<|im_end|>\n") and e.text.count("<|im_start|>") >= 3
    assert chat_format.read_back(chat_format.format_prefix_targets(turns.limit(0))).count() == 0


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(spark, docs, empty, monkeypatch):
    rng = random.Random(9)
    rows = some_docs()
    base = [f"w{i}" for i in range(120)]
    for k in range(60):  # a chain of edits: neighbours are alike, ends are not
        base[rng.randrange(120)] = f"x{k}"
        rows.append((2_000 + k, " ".join(base), "en", "s", 0))
    rows += [(3_000, "one two", None, None, 0), (3_001, "ONE two", None, None, 0), (3_002, "one two three", None, None, 0)]
    want, sets = brute_components(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash")).repartition(4)
    for texts in (1_000, 7):
        monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", texts)
        got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [("2", "2", True), ("7", "7", True), ("7", "7", True), ("None", "None", True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 100), (5, 5), (None, 3), (100, 101)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contained_items(spark, docs, empty, monkeypatch):
    rows = some_docs()
    rng = random.Random(4)
    long = words(rows[-1][1])
    items = [(k, " ".join(long[s : s + n])) for k, (s, n) in enumerate([(100, 15), (5_000, 60), (39_000, 400), (20, 6)])]
    items += [(10, "not in any text at all my friend indeed"), (11, None), (12, ""), (13, "solo"), (None, " ".join(long[900:930]))]
    half = long[700:750]
    for k in rng.sample(range(50), 2):
        half[k] = "changed"
    items.append((14, " ".join(half)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, *_ in rows:
        mine = shingles(t)
        for j, x in items:
            q = shingles(x)
            if q and len(q & mine) >= 0.75 * len(q):
                want.add((i, j, len(q & mine), len(q)))
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in containment.find_contained(docs, bench).collect()} == want
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in containment.find_contained(docs, bench, block_items=3).collect()} == want
    bad = {w[0] for w in want}
    kept = containment.without_contained(docs, bench, block_items=4)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - bad and kept.columns == docs.columns
    assert containment.find_contained(empty, bench).count() == 0 and containment.find_contained(docs, bench.limit(0)).count() == 0


def test_short_items_in_long_documents(spark):
    """Items of 5 to 8 words, whole or with 3 of 4 shingles, are found wherever they stand; none may be left to chance."""
    rng = random.Random(12)
    texts = [[f"v{d}x{rng.randrange(10**6)}" for _ in range(400)] for d in range(60)]
    items, common = [], ["all", "of", "the", "above", "answers"]
    for d, t in enumerate(texts):
        for n in (5, 6, 7, 8):
            s = rng.randrange(0, 380)
            items.append((len(items), " ".join(t[s : s + n])))
            if n == 8:
                items.append((len(items), " ".join([*t[s : s + 7], "changed"])))
        items.append((len(items), " ".join([*common, *t[10:13]])))
        t[200:205] = common
    docs = [(d, " ".join(t)) for d, t in enumerate(texts)]
    mine = {d: shingles(t) for d, t in docs}
    want = {(d, i, len(q & mine[d]), len(q)) for i, x in items for q in [shingles(x)] for d, _ in docs if len(q & mine[d]) >= 0.75 * len(q)}
    assert len(want) > 250
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (100_000, 40):
        assert {tuple(r) for r in containment.find_contained(df, bench, block_items=block).collect()} == want
    few = spark.createDataFrame([items[k] for k in (0, 7)], bench.schema)
    left = {r.doc_id for r in containment.without_contained(df, few).collect()}
    assert left == set(mine) - {d for d, i, *_ in want if i in (0, 7)}


def test_bpe_round_trip(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe_automaton.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    for r in bpe_automaton.decode(bpe_automaton.encode(docs.withColumn("ids", F.lit(0)), path), path).collect():
        text = next(t for i, t, *_ in some_docs() if i == r.doc_id) or ""
        assert r.ids == lib.encode(text, add_special_tokens=False).ids and r.decoded == lib.decode(r.ids, skip_special_tokens=False)
    assert bpe_automaton.encode(empty, path).count() == 0


def test_segments(spark, docs, empty, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = rans_tokens.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    written = rans_tokens.write_segments(docs.withColumn("body", F.lit(0)), f"file://{tmp_path}/a", path, 2, segment_tokens=3_000)
    got = sorted(rans_tokens.read_segments(written).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t, *_) in zip(got, sorted(some_docs(), key=lambda r: r[0]), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        start += len(ids)
    assert rans_tokens.read_segments(rans_tokens.write_segments(empty, f"file://{tmp_path}/b", path, 2)).count() == 0
    odd = spark.createDataFrame([(None, "x"), (3, None), (3, "y")], "doc_id long, text string")
    assert [r.doc_id for r in sorted(rans_tokens.read_segments(rans_tokens.write_segments(odd, f"file://{tmp_path}/c", path, 2)).collect(), key=lambda r: r.start)][0] is None


def test_png_columns(docs, empty):
    for r in png_media.read_png(png_media.encode_png(docs.withColumn("png", F.lit(0)))).collect():
        raw = (next(t for i, t, *_ in some_docs() if i == r.doc_id) or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.payload) == raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert png_media.read_png(png_media.encode_png(empty)).count() == 0


def test_language(spark, empty):
    rng = random.Random(3)
    stems = {"en": ["the", "ing", "and", "th", "wh", "ed"], "fr": ["que", "é", "le", "eau", "è", "ment"], "de": ["sch", "ü", "der", "ung", "ß", "ein"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 3))) for _ in range(30)), k) for i, k in enumerate(rng.choice(list(stems)) for _ in range(200))]
    rows += [(900, None, "en"), (901, "123 !?", "fr"), (902, "the and " * 60_000, None), (None, "der ung schein", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_score", F.lit("clash"))
    model = language_id.fit(df.where("doc_id % 2 = 0"), per_lang=40, landmarks_per_lang=8)
    out = language_id.identify(df, model).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 900) and all(0 <= r.lang_score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[901].lang_score == 0 and by[902].lang_pred == "en"
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_languages_of_several_scripts(spark):
    """Twelve languages, made of letters of their own script; three of them in code points that share their range."""
    rng = random.Random(8)
    letters = {"zh": "的一是不了在人有我他这中大来上国", "ja": "のはをにがでとたしてるいなもさ日", "ko": "이다는을의가에한고하도로지사서", "yi": "ꀀꀁꀂꀃꀄꀅꀆꀇꀈꀉꀊ", "zh2": "們個這來國說為會學後過發無開見", "he": "אבגדהוזחטיכלמנס", "ar": "ابتثجحخدذرزسشصض", "el": "αβγδεζηθικλμνξο", "ru": "абвгдежзиклмноп", "hi": "कखगघचछजझटठडढतथद", "th": "กขคงจฉชซญดตถทธน", "am": "ሀለሐመሠረሰሸቀበተቸኀነ"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 6))) for _ in range(12)), k) for i, k in enumerate(sorted(letters) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 120"), per_lang=10, landmarks_per_lang=5)
    out = language_id.identify(df, model).collect()
    assert len(out) == 240 and [r for r in out if r.lang_pred != r.lang] == []


def test_pipeline(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw = {r.doc_id: r.text for r in docs.collect()}
    stage = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in stage.select("doc_id").collect()}
        stage = step(spark, stage, sf)
        assert stage.columns == docs.columns
        assert {r.doc_id for r in stage.select("doc_id").collect()} <= before
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe_automaton.default_path())
    kept = {r.doc_id: r.text for r in stage.collect()}
    assert set(final) == set(kept) and len(kept) < len(raw)
    for i, t in kept.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert final[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
