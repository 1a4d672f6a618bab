"""Approximate vector search: inverted lists under learnt centroids, product-quantised residuals, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import stored
from lectern.operators.retrieval import _Best, _vectors, cosine_similarity


@dataclass(frozen=True)
class VectorCodes:
    """Centroids of the lists, and for each group of neighbouring dimensions the words of residuals; a few hundred kilobytes."""

    centroids: np.ndarray  # (lists, dimensions)
    words: np.ndarray  # (groups, words, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector and its code, a byte for each group."""
        at = np.argmax(x @ self.centroids.T, 1)
        rest = self._grouped(x - self.centroids[at])
        code = np.empty(rest.shape[:2], np.uint8)
        for g, words in enumerate(self.words):
            code[:, g] = np.argmin((words**2).sum(1) - 2 * rest[:, g] @ words.T, 1)
        return at, code

    def decode(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        rest = self.words[np.arange(len(self.words)), code].reshape(len(code), -1)
        return self.centroids[at] + rest[:, : self.centroids.shape[1]]

    def _grouped(self, rest: np.ndarray) -> np.ndarray:
        groups, _, width = self.words.shape
        out = np.zeros((len(rest), groups * width))
        out[:, : rest.shape[1]] = rest
        return out.reshape(len(rest), groups, width)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """k-means of the rows; a centre that loses all rows takes the row farthest from its own."""
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        far = (c**2).sum(1) - 2 * x @ c.T
        at = far.argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for lost in np.flatnonzero(n == 0):
            c[lost] = x[(far.min(1) + (x**2).sum(1)).argmax()]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_codes(embeddings: DataFrame, lists: int = 64, words: int = 64, width: int = 2, sample: int = 10_000, rounds: int = 12, seed: int = 5) -> VectorCodes | None:
    """The codes, learnt from ``sample`` vectors at most, those whose ids have the smallest hashes; None without a vector that has a norm.

    Lists are for vectors that form clusters; where they don't, all lists are
    searched. ``width`` dimensions share a word.
    """
    if not 1 <= words <= 256:
        raise ValueError("a code is a byte: 1 to 256 words")
    rows = embeddings.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    _, x = _vectors(pa.array([r.embedding for r in rows], pa.list_(pa.float64())))
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    centroids = _means(x, lists, rounds, rng, unit=True)
    rest = x - centroids[np.argmax(x @ centroids.T, 1)]
    groups = -(-x.shape[1] // width)
    padded = np.zeros((len(x), groups * width))
    padded[:, : x.shape[1]] = rest
    parts = padded.reshape(len(x), groups, width)
    return VectorCodes(centroids, np.stack([_means(parts[:, g], words, rounds, rng) for g in range(groups)]))


def build_index(embeddings: DataFrame, codes: VectorCodes) -> DataFrame:
    """(list, vec_id, code) of every vector that has a norm: some 40 bytes a vector instead of its numbers. No shuffle."""
    shared = embeddings.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4_000):
                part = b.slice(lo, 4_000)
                some, x = _vectors(part.column(1))
                if len(some):
                    at, code = shared.value.encode(x)
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))])
                    yield pa.record_batch([pa.array(at.astype(np.int32)), part.column(0).take(pa.array(some)), flat.cast(pa.binary())], ["list", "vec_id", "code"])

    held = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("embedding"))
    return held.mapInArrow(run, "list int, vec_id long, code binary")


def candidates(queries: DataFrame, index: DataFrame, codes: VectorCodes, keep: int, probes: int | None = None, most_values: int = 4_000_000) -> DataFrame:
    """(query_id, vec_id): for each query the ``keep`` vectors of the ``probes`` nearest lists (None: all) whose codes are most like it.

    Queries go out in blocks of at most ``most_values`` numbers; a task keeps its
    best ``keep`` for each query, and a window ranks those of all tasks.
    """
    spark = queries.sparkSession
    asked = queries.where(F.size("embedding") > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    passes = max(1, -(-asked.count() * codes.centroids.shape[1] // most_values))
    out = spark.createDataFrame([], "query_id long, vec_id long, tie long, similarity double")
    for p in range(passes):
        rows = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)).collect()
        at, matrix = _vectors(pa.array([r.embedding for r in rows], pa.list_(pa.float64())))
        if not len(at):
            continue
        near = np.argsort(-(matrix @ codes.centroids.T), axis=1, kind="stable")[:, : probes or len(codes.centroids)]
        asks = np.zeros((len(matrix), len(codes.centroids)), bool)
        np.put_along_axis(asks, near, True, 1)
        shared = spark.sparkContext.broadcast((np.array([rows[i].query_id for i in at]), matrix, asks, codes))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, asks, codes = shared.value
            top = _Best(len(names), keep)
            step = max(keep, 4_000_000 // max(1, len(names)))
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    lists = part.column(0).to_numpy()
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
                    sim = q @ codes.decode(lists, code).T
                    sim[~asks[:, lists]] = -np.inf
                    top.add(sim, np.zeros(len(lists), np.int64), part.column(1).to_numpy())
            yield top.rows(names)

        out = out.unionByName(index.select("list", "vec_id", "code").mapInArrow(best, "query_id long, vec_id long, tie long, similarity double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select("query_id", "vec_id")


def rerank(pairs: DataFrame, queries: DataFrame, embeddings: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank_no): the pairs by their true cosine, as ``vector_search`` ranks."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("a"))
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    scored = pairs.join(e, "vec_id").join(q, "query_id").select("query_id", "vec_id", F.round(cosine_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank_no", F.row_number().over(w).cast("long")).where(F.col("rank_no") <= limit)


def approximate_vector_search(queries: DataFrame, embeddings: DataFrame, limit: int = 10, keep: int = 6, probes: int | None = None, codes: VectorCodes | None = None) -> DataFrame:
    """Like ``vector_search``; the true vectors are read and compared only for ``keep`` * ``limit`` candidates of each query.

    Codes are learnt, and the index is made, for this call; for many searches use
    ``fit_codes``, ``build_index``, ``candidates`` and ``rerank``. Zero and null vectors
    have no rank. With ``probes`` a query looks at so many lists only.
    """
    codes = codes or fit_codes(embeddings)
    if codes is None:
        return queries.select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("rank_no")).where("false")
    index = stored(build_index(embeddings, codes), "vector-index")
    return rerank(candidates(queries, index, codes, keep * limit, probes), queries, embeddings, limit)
