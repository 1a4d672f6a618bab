"""Personal data: base spans against the plain patterns, estimates against planted votes, and the classifier on held-out spans."""

import hashlib
import random
import re

import numpy as np
import pyarrow  # noqa: F401
from pyspark.sql import functions as F

from lectern.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_sum(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and check_sum(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def card(rnd, n=16):
    d = "4" + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if check_sum(d + c))


def snippets(rnd):
    quad = ".".join(str(rnd.randrange(300)) for _ in range(rnd.choice([4, 4, 3, 5])))
    return [
        f"a.b{rnd.randrange(9)}@mail-{rnd.randrange(9)}.example.com", "x@y", "@@a@b.c_d@e.f", "a@b.c.@d.e", "%+@q.-", quad, "001.02.0003.255", card(rnd), card(rnd, 19),
        " ".join(re.findall("....", card(rnd))), "-".join(re.findall("....", card(rnd))), "4" * 16, "+1 (555) 123-4567", "+49 30 1234567", "+1-2", "+", "7+8 (9", "٣٤٥+١", "é😀", "word", "1 2 3", "\n",
    ]


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(4)
    for _ in range(3_000):
        text = "".join(rnd.choice([rnd.choice(snippets(rnd)), rnd.choice([" ", "", ".", "-", "@", "a", "5", "+"])]) for _ in range(rnd.randrange(14)))
        got = [(pii.KINDS[k], s, e) for s, k, e, is_base in pii.candidates(text) if is_base]
        assert got == base(text), text


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1" * 5_000 + ".1.1.1", "(" * 100_000):
        pii.candidates(text)
    assert [s[:3] for s in pii.candidates("0" * 9_000 + "7.1.1.1")] == [(0, pii.IP, 9_007)]


def test_estimates_of_planted_labelers():
    """Votes drawn with known rates give the rates back."""
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.3
    rates = np.array([[[0.1, 0.8, 0.1], [0.05, 0.15, 0.8]], [[0.7, 0.1, 0.2], [0.1, 0.1, 0.8]], [[0.5, 0.2, 0.3], [0.2, 0.2, 0.6]], [[0.2, 0.7, 0.1], [0.05, 0.5, 0.45]], [[0.6, 0, 0.4], [0.1, 0, 0.9]], [[0.5, 0.1, 0.4], [0.15, 0.05, 0.8]]])
    votes = np.stack([(rng.random((len(truth), 1)) > np.cumsum(rates[k, truth.astype(int)], 1)).sum(1).clip(0, 2) for k in range(6)], 1)
    patterns, counts = np.unique(votes @ 3 ** np.arange(5, -1, -1), return_counts=True)
    q, prior, got = pii.estimate(patterns, counts.astype(float), 500)
    assert abs(prior - truth.mean()) < 0.02 and np.abs(got - rates).max() < 0.03


def some_texts(seed, n):
    rnd = random.Random(seed)
    words = "the of and in order report value shelf room blue".split()
    out, want = [], []
    for _ in range(n):
        fill = [rnd.choice(words) for _ in range(8)]
        local = f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
        kind = rnd.randrange(6)
        true = {0: ("call me at phone ", local), 1: ("write to e-mail ", f"joe{rnd.randrange(99)} (at) example (dot) org"), 2: ("server ", f"10.2.{rnd.randrange(255)}.{rnd.randrange(255)}"), 3: ("card ", card(rnd)), 4: ("tel ", f"+1 {local}")}.get(kind)
        decoy = "".join(rnd.choice("0123456789") for _ in range(15))
        decoy += next(c for c in "0123456789" if not check_sum(decoy + c))
        cue, span = true or ("serial ", decoy)
        text = " ".join(fill[:4]) + " " + cue + span + " " + " ".join(fill[4:])
        out.append(text)
        want.append((text.index(span), text.index(span) + len(span)) if true else None)
    return out, want


def test_classifier_on_held_out_texts(spark):
    learnt, _ = some_texts(1, 1_500)
    docs = spark.createDataFrame(list(enumerate(learnt)), "doc_id long, text string")
    model = pii.learn(pii.with_candidates(docs))
    held, want = some_texts(2, 600)
    found = pii.judged(pii.with_candidates(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")), model).collect()
    hit = sum(want[r.doc_id] in [(s.start, s.end) for s in r.spans] for r in found if want[r.doc_id])
    wrong = sum(bool(r.spans) for r in found if not want[r.doc_id])
    assert hit >= 0.97 * sum(w is not None for w in want) and wrong == 0
    assert sum(not s.base for r in found for s in r.spans) > 100
    text = "mail a@b.com or +1 (555) 123-4567 x"
    clean = pii.redact(spark.createDataFrame([(1, text, "s"), (2, None, "t"), (3, "", "u")], "doc_id long, text string, spans string"), model).collect()
    assert [tuple(r) for r in clean] == [(1, "mail [email] or [phone] x", "s"), (2, None, "t"), (3, "", "u")]


def test_query_and_edge_cases(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choice(snippets(rnd)) for _ in range(rnd.randrange(20)))) for k in range(80)]
    rows += [(200, None), (201, ""), (None, "a@b.com"), (202, "a@b.com +1 (555) 123-4567"), (202, "a@b.com +1 (555) 123-4567"), (203, "z " * 60_000 + "10.0.0.1 é")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "spans": F.lit("x")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((str(r.doc_id), r.base_sha256, (r.n_email, r.n_ip, r.n_card, r.n_phone), r.spans) for r in pii.op12_weak_pii(spark, str(tmp_path)).collect()))
    want = []
    for i, t in rows:
        spans = base(t or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((str(i), hashlib.sha256(text.encode()).hexdigest(), tuple(sum(x[0] == k for x in spans) for k in pii.KINDS), text))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert set(filter(None, w[3].split(","))) <= set(g[3].split(","))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(empty).count() == 0
    assert [r.spans for r in pii.find_personal_data(spark.createDataFrame([(1, "plain words")], "doc_id long, text string")).collect()] == [[]]
