"""Language identification with a blended-spectrum string kernel.

The kernel of two texts compares the *sets* of their character n-grams of
lengths 1 to 3 (presence, not counts): the sum over the lengths of the shared
n-grams over the geometric mean of the set sizes. A bounded number of landmark
texts spans a Nyström feature space, where one ridge regression for each
language (one against the rest) is solved. Prediction is two matrix products a
block of documents.

Fitting uses a bounded sample: for each language the ``per_lang`` training
documents that come first by a hash of their id. Prediction covers every text,
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import free_names
from lectern.llm.textkit import chunks, mix, ragged, utf8

#: Code points there are; each is a symbol of its own, after folding.
POINTS = 0x110000
UNDETERMINED = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letter = np.fromiter((chr(i).isalpha() for i in range(POINTS)), bool, POINTS)
    fold = np.fromiter((ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(POINTS)), np.uint32, POINTS)
    fold[[*range(48, 58)]] = 48
    fold[[*range(9, 14)]] = 32
    return letter, fold


_LETTER, _FOLD = _tables()


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts and their offsets."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return cp, heads[offsets]


#: Rows whose n-grams one array may hold: the row's number stands above the n-gram's 58 bits.
ROWS = 64
_BITS = np.uint64(58)
#: Meetings of a text's n-gram with a landmark that are worked on at once.
MEETINGS = 1_000_000


def gram_sets(cp: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the lengths 1 to 3 the distinct n-grams of each text, as (row, hash), by row and hash.

    Up to ROWS texts. An n-gram of true code points has at most 63 bits, which a bijection scrambles; 58 of them are kept.
    """
    sym = _FOLD[np.minimum(cp, POINTS - 1)].astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    out, gram = [], sym
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] << np.uint64(21) | sym[n - 1 :]
        inside = row[: len(gram)] == row[n - 1 :]
        keys = np.sort(row[: len(gram)][inside] << _BITS | mix(gram[inside]) >> np.uint64(64) - _BITS)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        keys = keys[new]
        out.append(((keys >> _BITS).astype(np.int64), keys & (np.uint64(1) << _BITS) - np.uint64(1)))
    return out


@dataclass
class KernelModel:
    """The n-grams of the landmarks and ridge weights; as large as the landmark texts, whatever the input.

    ``grams`` has for each length the sorted n-grams, the places of their
    landmarks in the next array, those landmarks, and each landmark's number of n-grams.
    """

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: np.ndarray
    scale: float = 4.0

    def kernel(self, sets: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        """Blended kernel values of each text of ``gram_sets`` with each landmark."""
        out = 0
        for (row, gram), (known, first, landmark, size) in zip(sets, self.grams):
            mine = np.sqrt(np.bincount(row, minlength=rows).astype(np.float32))
            norm = np.outer(mine, np.sqrt(size.astype(np.float32)))
            shared = np.zeros((rows, len(size)), np.float32)
            if len(known):
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                hit = known[at] == gram
                at, row = at[hit], row[hit]
                many = first[at + 1] - first[at]
                step = max(1, MEETINGS // len(size))
                for a in range(0, len(at), step):
                    part, n = at[a : a + step], many[a : a + step]
                    cell = np.repeat(row[a : a + step] * len(size), n) + landmark[ragged(first[part], n)]
                    shared += np.bincount(cell, minlength=shared.size).reshape(shared.shape)
            out = out + np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0)
        return out / 3

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score for each text; ``und`` and 0 where it has no letter."""
        cp, off = code_points(buf, offsets)
        letters = np.concatenate([[0], np.cumsum(_LETTER[np.minimum(cp, 0x10FFFF)])])
        known = letters[off[1:]] > letters[off[:-1]]
        if not self.langs:
            return [UNDETERMINED] * len(known), np.zeros(len(known))
        margins = np.round(self.kernel(gram_sets(cp, off), len(known)) @ self.weights, 5) * self.scale
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = margins.argmax(1)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, p.max(1).astype(np.float64), 0.0)


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, max_langs: int, most_chars: int, most_total: int = 10_000_000) -> DataFrame:
    """At most ``per_lang`` texts of each of the ``max_langs`` most frequent languages, first by a hash of the id.

    Texts of more than ``most_chars`` signs are not in the sample, and each language has
    an equal share of ``most_total`` signs, so the size of the sample is bounded by it.
    The ranking carries ids only, and ties fall to the text's hash, so the sample is the same in each run.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("draw")).where("lang is not null and text is not null").where(F.length("text") <= most_chars)
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    top = top.select("lang", F.count("*").over(Window.partitionBy(F.lit(0))).alias("langs"))  # max_langs rows at most
    w = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.join(F.broadcast(top), "lang").withColumns({"rank": F.row_number().over(w), "signs": F.sum(F.length("text")).over(w)})
    return ranked.where((F.col("rank") <= per_lang) & (F.col("signs") * F.col("langs") <= most_total))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 150, landmarks_per_lang: int = 16, max_langs: int = 200, most_chars: int = 20_000, most_total: int = 10_000_000, ridge: float = 1e-3) -> KernelModel:
    """Fits the model on the bounded sample of ``training_sample``.

    The driver holds whole texts of ``most_total`` signs at most, some 50 bytes of
    n-grams for each. Rows without a language or text are left out; of equal languages in
    frequency the first by name is taken. No labelled row gives a model without
    languages, which answers ``und``.
    """
    picked = training_sample(labelled, id_col, text_col, lang_col, per_lang, max_langs, most_chars, most_total)
    rows = sorted(picked.select("lang", "rank", "text").collect())
    langs = sorted({r.lang for r in rows})
    if not langs:
        return KernelModel([], [], np.zeros((0, 0), np.float32))
    buf, off = utf8(pa.array([r.text for r in rows]))
    cp, cpo = code_points(buf, off)
    parts = [*chunks(cpo, 1_000_000, ROWS)]
    sets = [gram_sets(cp[cpo[a] : cpo[b]], cpo[a : b + 1] - cpo[a]) for a, b in parts]
    lang = np.array([langs.index(r.lang) for r in rows])
    chosen = np.array([r.rank <= landmarks_per_lang for r in rows])
    number = np.cumsum(chosen) - 1
    grams = []
    for n in range(3):
        of = np.concatenate([x[n][0] + a for x, (a, _) in zip(sets, parts)])
        gram = np.concatenate([x[n][1] for x in sets])[chosen[of]]
        of = number[of[chosen[of]]]
        order = np.argsort(gram, kind="stable")
        known, first = np.unique(gram[order], return_index=True)
        grams.append((known, np.append(first, len(gram)), of[order].astype(np.int32), np.bincount(of, minlength=int(chosen.sum()))))
    model = KernelModel(langs, grams, np.zeros((0, 0)))
    k = np.concatenate([model.kernel(x, b - a) for x, (a, b) in zip(sets, parts)]).astype(np.float64)
    values, vectors = np.linalg.eigh((k[chosen] + k[chosen].T) / 2)
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    phi = k @ nystrom
    target = np.where(lang[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(lang)[lang][:, None]  # each language counts alike
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (weight * target))
    model.weights = (nystrom @ solved).astype(np.float32)
    return model


def identify(df: DataFrame, model: KernelModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """All columns of ``df`` and the two predicted ones; a column of such a name is replaced.

    Null texts and texts without a letter get ``und`` and score 0. No shuffle.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    df = df.drop(lang_out, score_out)
    place = df.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, off = utf8(b.column(place))
            for lo, hi in chunks(off, 400_000, 48):
                langs, scores = m.predict(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                part = b.slice(lo, hi - lo)
                yield pa.record_batch([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_out, score_out])

    return df.mapInArrow(run, f"{fields}, `{lang_out}` string, `{score_out}` double")


def _held_out(df: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~_held_out(docs)))
    out = identify(docs.select("doc_id", "text"), model, score_out="score")
    return out.select("doc_id", _held_out(docs).alias("held_out"), "lang_pred", "score")


def select_languages(df: DataFrame, model: KernelModel, languages: list[str] | None = None, min_score: float = 0.5, min_letters: int = 20, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of ``languages`` (None: any that the model knows).

    A text is rejected if it has no letter; if its language is another one; or if
    it has ``min_letters`` letters or more, enough to tell, and the likeliest
    language scores less than ``min_score``, so that it is in none of them. A
    model without languages decides nothing: all rows stay. Repeated rows are
    judged alike; all columns stay as they were.
    """
    if not model.langs:
        return df
    names = free_names(df, "lang_pred", "lang_score")
    lang, score, letters = *map(F.col, names), F.length(F.regexp_replace(text_col, "\\P{L}+", ""))
    known = lang != UNDETERMINED
    if languages is not None:
        known = known & lang.isin(languages)
    judged = identify(df, model, text_col, *names).where(known & ((score >= min_score) | (letters < min_letters)))
    return judged.drop(*names)


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in none of the corpus's languages, by ``select_languages``.

    The model is learnt from the rows with a language that are not held out. Null
    and empty texts have no letter and go. A corpus without a labelled row, or
    without the column ``lang``, stays whole; an empty one gives no rows.
    """
    if "lang" not in docs.columns:
        return docs
    return select_languages(docs, fit(docs.where(~_held_out(docs))))
