"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Strict patterns find the base spans, which always stay. Looser patterns add
candidates. Six labelers vote yes, no or nothing on every candidate: the strict
pattern, a checksum or range rule, gazetteers (top-level domains, card issuers,
country and area codes, address ranges), cue words before the span, the signs
around it and its digits. The votes of all candidates of the corpus are counted by
pattern of votes (at most 4 * 3**6 counts), and expectation-maximisation estimates
from the counts how often each labeler votes what for true and for false spans.
The posterior of a pattern is the target of a logistic span classifier on hashed
features of the span and its surroundings, which then scores every candidate.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("pattern", "rule", "gazetteer", "cue", "border", "digits")
#: Hashed features of the classifier.
DIM = 1 << 14
#: Signs before and after a span that labelers and features look at.
AROUND = 48

# Fixed values of public registries and standards.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app de fr es it nl be ch at uk us ca au nz jp cn in br mx ar pl se no fi dk pt ru eu".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
CUES = {
    EMAIL: re.compile(r"(?i)e-?mail|mailto|contact|correo|courriel|write to"),
    IP: re.compile(r"(?i)\bip\b|address|host|server|client|gateway|login from"),
    CARD: re.compile(r"(?i)card|visa|master|amex|credit|karte|tarjeta|carte|payment"),
    PHONE: re.compile(r"(?i)\btel|phone|call|fax|mobile|cell|whatsapp|telefon|tél"),
}
NO_CUES = re.compile(r"(?i)version|token|sha|hash|isbn|serial|order no|invoice|build|section|\bid\b\W*$")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = (
    (EMAIL, ("(at)", "[at]"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}){1,8}")),
    (IP, (":",), re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (CARD, (), re.compile(r"(?<![0-9A-Za-z])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])")),
    (PHONE, ("+",), re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")),
    (PHONE, (), re.compile(r"(?<![0-9A-Za-z+().-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
)


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text.

    A match holds one @, so the first @ with a sign before and a domain behind it
    is the next match, and it starts where the signs before that @ begin.
    """
    left, at = 0, text.find("@")
    while at >= 0:
        start = left + len(text[left:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        left = domain.end() if domain else at + 1
        if domain:
            yield start, left
        at = text.find("@", left)


def strict(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans (start, kind, end), and the matches of the base patterns that fail their rule."""
    good, bad = [(s, EMAIL, e) for s, e in emails(text)], []
    for m in _IP.finditer(text):
        fine = all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p.lstrip("0")) <= 3 else 999) <= 255 for p in m.group().split("."))
        (good if fine else bad).append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(d) <= 19:
            (good if luhn(d) else bad).append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 10 <= len(_digits(m.group())) <= 15 else bad).append((m.start(), PHONE, m.end()))
    return good, bad


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) in order: the base spans, and what else looks like one and overlaps none of its kind."""
    good, bad = strict(text)
    out = {(s, k, e): True for s, k, e in good}
    taken: dict[int, list[tuple[int, int]]] = {k: [(s, e) for s, j, e in good if j == k] for k in range(4)}
    loose = list(bad)
    for kind, signs, pattern in _LOOSE:
        if not signs or any(s in text for s in signs):
            loose += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    if loose:
        edges = {k: (np.array([s for s, _ in v], np.int64), np.array([e for _, e in v], np.int64)) for k, v in taken.items()}
        for s, k, e in loose:
            starts, ends = edges[k]
            at = int(np.searchsorted(starts, e)) - 1  # the last base span that begins before the end
            if at < 0 or ends[at] <= s:
                out.setdefault((s, k, e), False)
    return sorted((s, k, e, base) for (s, k, e), base in out.items())


def _rule(kind: int, span: str, base: bool) -> int:
    if kind == CARD:
        d = _digits(span)
        return 1 if 13 <= len(d) <= 19 and luhn(d) else -1
    if base:
        return 1
    if kind == PHONE:
        return 1 if 10 <= len(_digits(span)) <= 15 else -1
    if kind == IP:
        return 1 if ":" in span else -1
    return 1


def _gazetteer(kind: int, span: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[.\])\s]", span)[-1].lower() in TOP_LEVEL else -1
    if kind == CARD:
        return 1 if ISSUERS.match(_digits(span)) else -1
    if kind == PHONE:
        d = _digits(span)
        if span.startswith("+") or d.startswith("00"):
            return 1 if d.lstrip("0").startswith(COUNTRY_CODES) else -1
        return 1 if d[:1] > "1" and d[3:4] > "1" else -1
    if ":" in span:
        return 1 if span[0] in "23fF" else 0
    return -1 if span.split(".")[0] in ("0", "255") or span.startswith("1.2.3") else 1


def votes(text: str, start: int, kind: int, end: int, base: bool) -> int:
    """The labelers' votes as one number of base three (0 no, 1 nothing, 2 yes)."""
    span, before = text[start:end], text[max(start - AROUND, 0) : start]
    cue = 1 if CUES[kind].search(before) else -1 if NO_CUES.search(before) else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    border = -1 if left.isalnum() or right.isalnum() or left in (".", "-") and left else 1
    d = _digits(span)
    digits = 0 if kind == EMAIL or ":" in span else 1 if len(set(d)) >= 4 else -1
    out = 0
    for v in (1 if base else 0, _rule(kind, span, base), _gazetteer(kind, span), cue, border, digits):
        out = out * 3 + v + 1
    return out


def _class(c: str) -> str:
    return "-" if not c else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else c


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features of a span: its shape and parts, and what stands around it."""
    span = text[start : min(end, start + 200)]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", span))
    before, after = text[max(start - AROUND, 0) : start], text[end : end + AROUND]
    words = re.findall(r"\w+", before.lower())
    found = [
        "", f"shape={shape[:40]}", f"size={min(end - start, 60)}", f"digits={len(_digits(span))}", f"head={span[:2]}", f"tail={span[-3:].lower()}",
        f"left={_class(text[start - 1 : start] if start else '')}", f"right={_class(after[:1])}", f"word={words[-1] if words else ''}", f"word2={words[-2] if len(words) > 1 else ''}",
        f"signs={''.join(sorted(set(re.sub('[A-Za-z0-9]', '', span))))[:12]}", f"sum={kind == CARD and luhn(_digits(span))}", f"kinds={len(set(_digits(span)))}",
    ]
    return sorted({zlib.crc32(f"{kind}|{x}".encode()) % DIM for x in found})


_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,pattern:int,features:array<int>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]))


def with_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): the candidates of each text with their votes and features. Rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = []
                for value in part.column(1):
                    text = value.as_py() or ""
                    rows.append([{"kind": k, "start": s, "end": e, "base": base, "pattern": votes(text, s, k, e, base), "features": features(text, s, k, e)} for s, k, e, base in candidates(text)])
                yield pa.record_batch([part.column(0), pa.array(rows, _ARROW)], ["doc_id", "found"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, found {_CANDIDATE}")


@dataclass
class SpanModel:
    """The classifier, and what was estimated on the way to it."""

    weights: np.ndarray
    #: For each kind: the share of true candidates, and for each labeler how often it votes no, nothing, yes on false and on true ones.
    priors: dict[str, float] = field(default_factory=dict)
    reliabilities: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-float(self.weights[f].sum()))) for f in features])


def _unpacked(patterns: np.ndarray) -> np.ndarray:
    """(n, labelers): the votes 0, 1, 2 of each pattern."""
    n = len(LABELERS)
    return np.stack([patterns // 3 ** (n - 1 - k) % 3 for k in range(n)], 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each pattern, share of true spans, and (labelers, 2, 3) vote rates, by expectation-maximisation.

    Labelers are taken as independent given the truth. It starts from the majority
    of the votes, which also says which of the two classes is the true one; a
    count of one half for each vote keeps rates off zero.
    """
    v = _unpacked(patterns)
    n = len(LABELERS)
    yes = (v - 1).sum(1)
    q = 1 / (1 + np.exp(-1.5 * (yes - 1.0)))
    for _ in range(rounds):
        rate = np.full((n, 2, 3), 0.5)
        for k in range(n):
            for vote in range(3):
                here = v[:, k] == vote
                rate[k, 1, vote] += (counts * q)[here].sum()
                rate[k, 0, vote] += (counts * (1 - q))[here].sum()
        rate /= rate.sum(2, keepdims=True)
        prior = ((counts * q).sum() + 1) / (counts.sum() + 2)
        logit = np.log(prior / (1 - prior)) + sum(np.log(rate[k, 1, v[:, k]] / rate[k, 0, v[:, k]]) for k in range(n))
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return q, float(prior), rate


def train(features: list[list[int]], target: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the logistic classifier, by Adam on all rows at once."""
    size = np.array([len(f) for f in features])
    col, row = np.concatenate([np.array(f, np.int64) for f in features]), np.repeat(np.arange(len(features)), size)
    w, m, s = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(row, w[col], len(features))))
        g = np.bincount(col, (p - target)[row], DIM) / len(features) + ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


def learn(found: DataFrame, train_spans: int = 5_000) -> SpanModel:
    """The model of a table of ``with_candidates``.

    Reliabilities are estimated from the votes of all candidates; the classifier
    is fitted on at most ``train_spans`` candidates of each kind, those with the
    smallest hashes. Without candidates it scores everything one half.
    """
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counted = each.groupBy("kind", "pattern").agg(F.count("*").alias("n")).orderBy("kind", "pattern").collect()  # at most 4 * 3**6 rows
    model = SpanModel(np.zeros(DIM))
    posterior: dict[tuple[int, int], float] = {}
    for kind, name in enumerate(KINDS):
        mine = [(r.pattern, r.n) for r in counted if r.kind == kind]
        if mine:
            patterns, n = (np.array(x) for x in zip(*mine))
            q, model.priors[name], model.reliabilities[name] = estimate(patterns, n.astype(float))
            posterior |= {(kind, int(p)): float(x) for p, x in zip(patterns, q)}
    if not posterior:
        return model
    order = F.xxhash64("doc_id", "kind", "start", "pattern")
    rows = []
    for kind in range(len(KINDS)):
        rows += each.where(F.col("kind") == kind).select(order.alias("h"), "kind", "pattern", "features").orderBy("h", "pattern", "features").limit(train_spans).collect()
    model.weights = train([r.features for r in rows], np.array([posterior[r.kind, r.pattern] for r in rows]))
    return model


def chosen(found: list[dict], model: SpanModel, threshold: float) -> list[dict]:
    """The base spans, and the other candidates that the classifier takes and that overlap no span before them."""
    score = model.scores([c["features"] for c in found])
    base = [(c, float(p)) for c, p in zip(found, score) if c["base"]]
    more = [(c, float(p)) for c, p in zip(found, score) if not c["base"] and p >= threshold]
    if more:
        edges = sorted((c["start"], c["end"]) for c, _ in base)
        starts, reach = np.array([s for s, _ in edges], np.int64), np.maximum.accumulate(np.array([e for _, e in edges], np.int64)) if edges else np.zeros(0, np.int64)
        last = -1
        for c, p in more:
            at = int(np.searchsorted(starts, c["end"])) - 1
            if c["start"] >= last and (at < 0 or reach[at] <= c["start"]):
                base.append((c, p))
                last = c["end"]
        base.sort(key=lambda x: (x[0]["start"], x[0]["kind"], x[0]["end"]))
    return [{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "score": p} for c, p in base]


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def judged(found: DataFrame, model: SpanModel, threshold: float = 0.9) -> DataFrame:
    """(doc_id, spans) from a table of ``with_candidates``."""
    shared = found.sparkSession.sparkContext.broadcast(model)  # DIM weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = [chosen(value.as_py() or [], shared.value, threshold) for value in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(rows, _SPAN_ARROW)], ["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id long, spans {_SPANS}")


def find_personal_data(docs: DataFrame, threshold: float = 0.9, train_spans: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: spans (kind, start, end, base, score) by start and kind, in code points.

    Null texts count as empty and have no spans; repeated rows give repeated rows,
    a null id stays null; other columns are ignored; an empty table gives no rows.
    The texts are read once: candidates go to a table, from which the votes are
    counted, the classifier is learnt and all are judged.
    """
    made: list[str] = []
    found = stored(with_candidates(docs, id_col, text_col), "pii-candidates", made)
    out = stored(judged(found, learn(found, train_spans), threshold), "pii-spans")
    discard(docs.sparkSession, made)
    return out


def redact(docs: DataFrame, model: SpanModel, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, each span of the text replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def clean(text: str) -> str:
        rows = [{"kind": k, "start": s, "end": e, "base": base, "features": features(text, s, k, e)} for s, k, e, base in candidates(text)]
        out, at = [], 0
        for c in chosen(rows, shared.value, threshold):
            if c["start"] >= at:
                out += [text[at : c["start"]], f"[{c['kind']}]"]
            at = max(at, c["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [None if (t := v.as_py()) is None else clean(t) for v in part.column(place)]
                yield pa.record_batch([pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(part.columns)], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op12_weak_pii(spark, sf_dir: str) -> DataFrame:
    """The personal data of every whole text of documents, as counts and digests of the base spans and all spans."""
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
