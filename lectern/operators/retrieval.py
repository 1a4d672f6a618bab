"""Scoped lexical, vector and hybrid retrieval for tables of queries, and evidence packages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import stored
from lectern.operators.extents import extent_scores, similar_extents
from lectern.operators.signals import TOKEN, lexical_signals, query_terms


# ---- authorisation and scope


def authorized_chunks(chunks: DataFrame, owner: str | Column) -> DataFrame:
    """Active chunks of one owner; filters come before any ranking."""
    return chunks.where(F.col("is_active") & (F.col("owner_id") == owner))


def filter_scope(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """Chunks whose material is in scope as a whole (null node) or by their node; an empty scope gives none."""
    s = scope.select(F.col("material_id").alias("__m"), F.col("node_id").alias("__n"))
    return chunks.join(s, (F.col("material_id") == F.col("__m")) & (F.col("__n").isNull() | (F.col("__n") == F.col("node_id"))), "left_semi")


def build_scope(targets: DataFrame) -> DataFrame:
    """One row for a topic and material: a whole material beats its listed nodes."""
    whole = F.bool_or(F.col("node_id").isNull())
    return targets.groupBy("topic", "material_id").agg(whole.alias("whole"), F.when(whole, F.array().cast("array<string>")).otherwise(F.array_sort(F.collect_set("node_id"))).alias("nodes"))


def freeze_scope(authorized: DataFrame, frozen: DataFrame) -> DataFrame:
    """The common part of two scopes (whole, nodes); whole on one side means the other side's nodes."""
    b = frozen.select("topic", "material_id", F.col("whole").alias("whole_b"), F.col("nodes").alias("nodes_b"))
    both = authorized.join(b, ["topic", "material_id"])
    nodes = F.when(F.col("whole") & F.col("whole_b"), F.array().cast("array<string>")).when(F.col("whole"), F.col("nodes_b")).when(F.col("whole_b"), F.col("nodes")).otherwise(F.array_sort(F.array_intersect("nodes", "nodes_b")))
    out = both.select("topic", "material_id", (F.col("whole") & F.col("whole_b")).alias("whole"), nodes.alias("nodes"))
    return out.where(F.col("whole") | (F.size("nodes") > 0))


def visible(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """The pairs (query_id, chunk_id, ...) that the query's owner may see.

    Queries with ``owner_id`` see active chunks of that owner; ``scope``
    (query_id, material_id, node_id; a null node is the whole material) narrows
    that, and a query without a row in it sees nothing.
    """
    owned = "owner_id" in queries.columns
    if not owned and scope is None:
        return pairs
    there = chunks.select("chunk_id", *[F.col(c).alias(f"__{c}") for c in ("owner_id", "is_active", "material_id", "node_id") if c in chunks.columns])
    out = pairs.join(there, "chunk_id")
    if owned:
        owners = queries.select(F.col("query_id").alias("__q"), F.col("owner_id").alias("__owner"))
        out = out.join(owners, (F.col("query_id") == F.col("__q")) & (F.col("__owner") == F.col("__owner_id")), "left_semi").where("__is_active")
    if scope is not None:
        s = scope.select(F.col("query_id").alias("__q"), F.col("material_id").alias("__m"), F.col("node_id").alias("__n"))
        out = out.join(s, (F.col("query_id") == F.col("__q")) & (F.col("__material_id") == F.col("__m")) & (F.col("__n").isNull() | (F.col("__n") == F.col("__node_id"))), "left_semi")
    return out.select(pairs.columns)


def literal_match(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs where the text holds the query literally, whatever the case; % and _ are plain signs.

    Words inside the query stand whole in the text, so a query of three words or
    more is looked for only in texts that have all of these; a shorter one may be
    cut inside its words, and is looked for in every text.
    """
    return lexical_signals(queries, chunks, literal=True).select("query_id", "chunk_id")


# ---- lexical search


def tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token): lower-case tokens of letters, digits and marks, with their places."""
    return texts.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))


def fts_match(queries: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(query_id, id) of the chunks that match."""
    return lexical_signals(queries, chunks, id_col, text_col, words=True).select("query_id", id_col).distinct()


def cover_density(queries: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(query_id, id, rank): the sum over minimal covers of all query words of 1 / cover length.

    A cover ends at a place where the earliest of the words' last places moves on.
    """
    return lexical_signals(queries, chunks, id_col, text_col, density=True).select("query_id", id_col, "rank")


def trigrams(text: Column) -> Column:
    """The set of three-sign pieces of each lower-case word, with two blanks before and one behind it."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda x: F.concat(F.lit("  "), x, F.lit(" ")))
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def trigram_share(queries: DataFrame, chunks: DataFrame, threshold: float, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(query_id, id, share): the share of the query's trigrams that the text has anywhere, from ``threshold`` on; an upper bound of the similarity."""
    q = queries.select("query_id", trigrams(F.col("query")).alias("g")).select("query_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    words = tokens(chunks, id_col, text_col).select(id_col, "token").distinct()
    vocabulary = words.select("token").distinct().select("token", F.explode(trigrams(F.col("token"))).alias("gram"))
    shared = q.join(vocabulary, "gram").join(words, "token").groupBy("query_id", "n", id_col).agg(F.count_distinct("gram").alias("m"))
    return shared.select("query_id", id_col, (F.col("m") / F.col("n")).alias("share")).where(F.col("share") >= threshold)


def word_similarity(queries: DataFrame, chunks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(query_id, chunk_id, similarity) from ``threshold`` on.

    The similarity is that of the query's trigrams with those of the stretch of the
    text that is most like it: shared trigrams by all of both. Each text is read
    once for all queries, by ``similar_extents``.
    """
    return similar_extents(queries, chunks, threshold)


def lexical_search(queries: DataFrame, chunks: DataFrame, limit: int = 10, similarity: float | None = 0.6, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, exact, rank, trigram, rank_no): matches by all words, literally or by trigrams, that the query may see.

    Owner and ``scope`` narrow the candidates before they are ranked, by ``visible``.
    Literal ones come first, then by cover density, then by the trigrams of the
    stretch most like the query, then by chunk_index (where there is one) and id.
    ``similarity`` is where trigrams alone are a match; None leaves this branch and
    its column out. Each text is read once for words, phrases and cover density.
    """
    pair, owned = ["query_id", "chunk_id"], "owner_id" in queries.columns
    if owned:
        chunks = chunks.where("is_active").join(queries.select("owner_id").distinct(), "owner_id", "left_semi")
    keep, owners = ("owner_id",) if owned else (), queries.select("query_id", "owner_id") if owned else None
    found = lexical_signals(queries, chunks, words=True, literal=True, density=True, keep=keep).where("matched or exact")
    if owned:
        found = found.join(owners, ["query_id", "owner_id"], "left_semi")
    seen = lambda df: df if scope is None else visible(df, queries, chunks, scope)
    signals = seen(found).select(*pair, "exact", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    order = [F.desc("exact"), F.desc("rank")]
    top = lambda df, *by: df.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("place") <= limit).drop("place")
    # what follows decides between equals: only pairs that it can bring to the top go on
    signals = top(signals, *order)
    if similarity is not None:
        near = stored(signals, "lexical-signals")
        alike = similar_extents(queries, chunks, similarity, keep)
        if owned:
            alike = alike.join(owners, ["query_id", "owner_id"], "left_semi")
        alike = stored(seen(alike).select(*pair, "similarity"), "alike")
        # matches that reach it are scored there already, however many there are
        scores = extent_scores(near.select(*pair).join(alike, pair, "left_anti"), queries, chunks).unionByName(alike)
        matched = near.join(scores.withColumnRenamed("similarity", "trigram"), pair)
        # other pairs come behind, the most similar first
        weak = top(alike.select(*pair, F.lit(False).alias("exact"), F.lit(0.0).alias("rank"), F.col("similarity").alias("trigram")), F.desc("trigram"))
        signals = matched.unionByName(weak).groupBy(*pair).agg(*[F.max(c).alias(c) for c in ("exact", "rank", "trigram")])
        order.append(F.desc("trigram"))
    columns = signals.columns
    if "chunk_index" in chunks.columns:
        signals = signals.join(chunks.select("chunk_id", "chunk_index"), "chunk_id")
        order.append("chunk_index")
    w = Window.partitionBy("query_id").orderBy(*order, "chunk_id")
    return signals.withColumn("rank_no", F.row_number().over(w).cast("long")).where(F.col("rank_no") <= limit).select(*columns, "rank_no")


# ---- vector search


def cosine_similarity(a: Column, b: Column) -> Column:
    """In double; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def embedding_violations(embeddings: DataFrame, dimension: int, generations: DataFrame | None = None) -> DataFrame:
    """Vectors of a wrong size, with a value that isn't finite, or of norm zero, with the reason.

    With ``generations`` (generation, model, dimension) a vector's generation must
    be there, its model that of the generation, and its size that generation's.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.lit(dimension)
    reason = F.when(v.isNull(), "MISSING")
    if generations is not None:
        g = generations.select("generation", F.col("model").alias("__model"), F.col("dimension").alias("__size"))
        embeddings, size = embeddings.join(g, "generation", "left"), F.col("__size")
        reason = reason.when(F.col("__model").isNull(), "GENERATION").when(~F.col("model").eqNullSafe(F.col("__model")), "MODEL")
    reason = reason.when(F.size(v) != size, "DIMENSION").when(bad, "NOT_FINITE").when(~F.exists(v, lambda x: x != 0), "ZERO_NORM")
    return embeddings.withColumn("reason", reason).where("reason is not null").select("vec_id", "reason")


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have a norm, and their vectors scaled to 1, without Python lists."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.diff(column.offsets.to_numpy())
    some = np.flatnonzero(size)
    if not len(some):
        return some, np.zeros((0, 0))
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False))
    width = int(size[some[0]])
    if (size[some] != width).any():
        raise ValueError("vectors of several sizes")
    x = flat.reshape(-1, width)
    norm = np.linalg.norm(x, axis=1)
    good = norm > 0
    return some[good], x[good] / norm[good, None]


class _Best:
    """The best rows of each query so far: similarity falling, then the tie's number, then the id."""

    def __init__(self, n: int, limit: int):
        self.limit, self.sim = limit, np.full((n, 0), -np.inf)
        self.tie, self.vec = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)

    def add(self, sim: np.ndarray, tie: np.ndarray, vec: np.ndarray) -> None:
        """``sim``: (queries, rows), -inf for rows that the query may not see."""
        if sim.shape[1] > self.limit:  # ties at the edge stay until they are ordered below
            edge = -np.partition(-sim, self.limit - 1, axis=1)[:, self.limit - 1]
            keep = (sim >= edge[:, None]).any(0)
            sim, tie, vec = sim[:, keep], tie[keep], vec[keep]
        s = np.concatenate([self.sim, sim], axis=1)
        t = np.concatenate([self.tie, np.broadcast_to(tie, sim.shape)], axis=1)
        v = np.concatenate([self.vec, np.broadcast_to(vec, sim.shape)], axis=1)
        order = np.lexsort((v, t, -s), axis=1)[:, : self.limit]
        self.sim, self.tie, self.vec = (np.take_along_axis(x, order, 1) for x in (s, t, v))

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        q, k = np.nonzero(np.isfinite(self.sim))
        return pa.record_batch([pa.array(names[q]), pa.array(self.vec[q, k]), pa.array(self.tie[q, k]), pa.array(self.sim[q, k])], ["query_id", "vec_id", "tie", "similarity"])


def vector_search(queries: DataFrame, embeddings: DataFrame, limit: int = 10, by: list[str] | None = None, tie: str | None = None, most_values: int = 4_000_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank_no): exact nearest vectors by cosine; of equal ones the lower ``tie``, then the lower id.

    ``queries``: (query_id, embedding). ``by``: columns of both tables that must be
    equal, such as the owner, so that a query is only compared with what it may see.
    Queries go out in blocks of at most ``most_values`` numbers (32 MB); each task
    keeps its best ``limit`` for each query, whatever the number of its rows, and a
    window ranks those. Zero and null vectors have no rank.
    """
    spark, by = queries.sparkSession, by or []
    same = F.xxhash64(*by) if by else F.lit(0).cast("long")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), same.alias("same")).where(F.size("embedding") > 0)
    total, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    passes = max(1, -(-total * (width or 1) // most_values))
    out = None
    for p in range(passes):
        rows = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)).collect()
        if not rows:
            continue
        at, matrix = _vectors(pa.array([r.embedding for r in rows], pa.list_(pa.float64())))
        shared = spark.sparkContext.broadcast((np.array([rows[i].query_id for i in at]), np.array([rows[i].same for i in at]), matrix))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, group, q = shared.value
            top = _Best(len(names), limit)
            step = max(limit, 4_000_000 // max(1, len(names)))
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    at, x = _vectors(part.column(3))
                    if len(at):
                        sim = np.round(q @ x.T, 9)
                        sim[group[:, None] != part.column(2).to_numpy()[at][None, :]] = -np.inf
                        top.add(sim, part.column(1).to_numpy()[at], part.column(0).to_numpy()[at])
            yield top.rows(names)

        held = embeddings.select(F.col("vec_id").cast("long"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie"), same.alias("same"), F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("embedding"))
        found = held.mapInArrow(best, "query_id long, vec_id long, tie long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("rank_no")).where("false")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "tie", "vec_id")
    return out.withColumn("rank_no", F.row_number().over(w).cast("long")).where(F.col("rank_no") <= limit).drop("tie")


def vector_status(queries: DataFrame, dimension: int) -> DataFrame:
    """The state of the vector channel of each query (scope_size, generations, embedding may be missing).

    Where the columns are there: ``provider`` tells whether there is one at all,
    ``failed`` whether it failed, ``model`` and ``generation_model`` must be equal.
    """
    v, has = F.col("embedding"), queries.columns
    status = F.when(F.col("scope_size") == 0, "EMPTY_SCOPE").when(F.col("generations") == 0, "NO_GENERATION")
    status = status.when(~F.col("provider"), "NO_PROVIDER") if "provider" in has else status
    status = status.when(F.col("failed"), "FAILED") if "failed" in has else status
    status = status.when(v.isNull(), "FAILED" if "provider" in has else "NO_PROVIDER")
    status = status.when(~F.col("model").eqNullSafe(F.col("generation_model")), "INCOMPATIBLE") if "model" in has else status
    status = status.when(F.size(v) != dimension, "INVALID" if "model" in has else "INCOMPATIBLE").when(~F.exists(v, lambda x: x != 0), "INVALID").otherwise("AVAILABLE")
    return queries.select("query_id", status.alias("status"))


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, generation: int | str) -> DataFrame:
    """Chunks without a vector in the generation."""
    return chunks.join(embeddings.where(F.col("generation") == generation), "chunk_id", "left_anti")


def embed_missing(chunks: DataFrame, existing: DataFrame, generation: int | str, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """(chunk_id, embedding) made by the caller's function for chunks that have none.

    ``fn`` gets and gives pandas frames; an answer for an id that wasn't asked for is an error.
    """
    wanted = missing_embeddings(chunks, existing, generation).select("chunk_id", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = pd.concat(list(fn(iter([f]))), ignore_index=True)
            if sorted(got["chunk_id"]) != sorted(f["chunk_id"]):
                raise ValueError("the embedding function must answer each id once")
            yield got[["chunk_id", "embedding"]]

    return wanted.mapInPandas(run, "chunk_id long, embedding array<double>")


# ---- fusion and evidence


@dataclass(frozen=True)
class FusionPolicy:
    """Weights and constant of reciprocal-rank fusion."""

    lexical_weight: float = 1.0
    vector_weight: float = 1.0
    k: int = 60

    def __post_init__(self):
        w = (self.lexical_weight, self.vector_weight)
        if not all(isfinite(x) and x >= 0 for x in w) or not any(w) or self.k < 1:
            raise ValueError("weights must be finite, not negative and not both zero; k at least 1")


def merge_channels(lexical: DataFrame, vector: DataFrame, provenance: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id, lexical_rank, vector_rank): the union of both channels.

    A chunk that a channel gives twice for a query is an error, and so is one whose
    ``provenance`` columns differ between the channels.
    """
    where = provenance or []
    a = lexical.select("query_id", "chunk_id", *where, F.col("rank_no").alias("lexical_rank"))
    b = vector.select("query_id", "chunk_id", *where, F.col("rank_no").alias("vector_rank"))
    both = a.unionByName(b, allowMissingColumns=True)
    kinds = F.count_distinct(F.struct(*where)) if where else F.lit(1)
    merged = both.groupBy("query_id", "chunk_id").agg(F.count("lexical_rank").alias("nl"), F.count("vector_rank").alias("nv"), kinds.alias("kinds"), F.min("lexical_rank").alias("lexical_rank"), F.min("vector_rank").alias("vector_rank"), *[F.first(c).alias(c) for c in where])
    twice = F.raise_error(F.concat(F.lit("a channel has chunk "), F.col("chunk_id").cast("string"), F.lit(" twice for query "), F.col("query_id").cast("string")))
    other = F.raise_error(F.concat(F.lit("the channels disagree on where chunk "), F.col("chunk_id").cast("string"), F.lit(" comes from")))
    rank = lambda c: F.when((F.col("nl") > 1) | (F.col("nv") > 1), twice.cast("long")).when(F.col("kinds") > 1, other.cast("long")).otherwise(F.col(c)).alias(c)
    return merged.select("query_id", "chunk_id", rank("lexical_rank"), rank("vector_rank"), *where)


def hybrid_fuse(lexical: DataFrame, vector: DataFrame, policy: FusionPolicy = FusionPolicy(), limit: int = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion: (query_id, chunk_id, lexical_rank, vector_rank, score, rank_no)."""
    part = lambda w, rank: F.coalesce(F.lit(w) / (policy.k + F.col(rank)), F.lit(0.0))
    scored = merge_channels(lexical, vector).withColumn("score", F.round(part(policy.lexical_weight, "lexical_rank") + part(policy.vector_weight, "vector_rank"), 9)).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank_no", F.row_number().over(w).cast("long")).where(F.col("rank_no") <= limit)


def inspect_retrieval(fused: DataFrame) -> DataFrame:
    """One row a query: its hits in order with the ranks in both channels, and counts."""
    return fused.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.count("lexical_rank").alias("lexical_hits"),
        F.count("vector_rank").alias("vector_hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("order"),
    )


def dedup_evidence(ranked: DataFrame) -> DataFrame:
    """The first row by rank of each (query, content)."""
    w = Window.partitionBy("query_id", F.xxhash64("content"), "content").orderBy("rank_no", "chunk_id")
    return ranked.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def budget_prefix(ranked: DataFrame, cost: Column, budget: int) -> DataFrame:
    """Rows by rank as long as their costs fit the budget together (costs are positive)."""
    w = Window.partitionBy("query_id").orderBy("rank_no").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(w).cast("long")).where(F.col("used") <= budget)


def retrieval_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """INSUFFICIENT without a hit, LIMITED if a source is LIMITED or POOR, else STRONG."""
    each = hits.groupBy("query_id").agg(F.bool_or(F.col("quality").isin("LIMITED", "POOR")).alias("weak"))
    return queries.select("query_id").join(each, "query_id", "left").select("query_id", F.when(F.col("weak").isNull(), "INSUFFICIENT").when(F.col("weak"), "LIMITED").otherwise("STRONG").alias("retrieval_quality"))


def collect_visuals(selected: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, visual_id, first_rank, chunk_ids): the visuals that the chosen chunks lead to."""
    return selected.join(links, "chunk_id").groupBy("query_id", "visual_id", "page_number", "status").agg(F.min("rank_no").alias("first_rank"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def build_evidence(queries: DataFrame, ranked: DataFrame, visuals: DataFrame, max_chunks: int = 5, max_visuals: int = 2) -> DataFrame:
    """One row a query: chosen chunks and visuals, and the codes of what limits them.

    ``queries``: (query_id, retrieval_quality); ``ranked``: (query_id, chunk_id, rank_no,
    quality); ``visuals``: links (chunk_id, visual_id, page_number, status).
    """
    chosen = ranked.where(F.col("rank_no") <= max_chunks)
    cut = ranked.groupBy("query_id").agg((F.max("rank_no") > max_chunks).alias("cut"))
    chunks = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "chunk_id", "quality"))).alias("chunks"))
    seen = collect_visuals(chosen, visuals)
    usable = seen.where(F.col("status").isin("SUPPORTED", "LIMITED")).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "page_number", "visual_id")))
    picked = usable.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") <= max_visuals, F.struct("n", "visual_id")))).alias("visuals"),
        F.bool_or((F.col("n") <= max_visuals) & (F.col("status") == "LIMITED")).alias("visual_limited"),
        (F.max("n") > max_visuals).alias("visual_cut"),
    )
    excluded = seen.where(~F.col("status").isin("SUPPORTED", "LIMITED")).select("query_id").distinct().withColumn("excluded", F.lit(True))
    q = queries.join(chunks, "query_id", "left").join(cut, "query_id", "left").join(picked, "query_id", "left").join(excluded, "query_id", "left")
    has = lambda kind: F.coalesce(F.exists("chunks", lambda x: x["quality"] == kind), F.lit(False))
    code = lambda cond, name: F.when(cond, F.lit(name))
    none = F.col("chunks").isNull()
    codes = F.array_compact(
        F.array(
            code(F.col("retrieval_quality") == "FAILED", "RETRIEVAL_FAILED"),
            code(F.col("cut"), "CHUNK_BUDGET_APPLIED"),
            code(has("LIMITED"), "LIMITED_CHUNK_SOURCE_QUALITY"),
            code(has("POOR"), "POOR_CHUNK_SOURCE_QUALITY"),
            code(F.col("visual_limited"), "LIMITED_VISUAL_INTERPRETATION"),
            code(F.col("excluded"), "VISUAL_EXCLUDED_BY_INTERPRETATION_STATUS"),
            code(F.col("visual_cut"), "VISUAL_BUDGET_APPLIED"),
            code((F.col("retrieval_quality") == "INSUFFICIENT") & none, "INSUFFICIENT_EVIDENCE"),
        )
    )
    ids = lambda col, field: F.coalesce(F.transform(col, lambda x: x[field]), F.array().cast("array<long>"))
    return q.select("query_id", "retrieval_quality", ids("chunks", "chunk_id").alias("chunk_ids"), ids("visuals", "visual_id").alias("visual_ids"), codes.alias("limitations"))


def evidence_violations(packages: DataFrame) -> DataFrame:
    """Packages that contradict themselves, with the first reason."""
    n = F.size("chunk_ids")
    reason = (
        F.when((F.col("retrieval_quality") == "FAILED") & (n > 0), "FAILED_WITH_CHUNKS")
        .when(F.col("retrieval_quality").isin("STRONG", "LIMITED") & (n == 0), "NO_CHUNK")
        .when(n != F.size(F.array_distinct("chunk_ids")), "REPEATED_CHUNK")
        .when(F.size("visual_ids") != F.size(F.array_distinct("visual_ids")), "REPEATED_VISUAL")
        .when((F.size("visual_ids") > 0) & (n == 0), "VISUAL_WITHOUT_CHUNK")
    )
    return packages.withColumn("reason", reason).where("reason is not null").select("query_id", "reason")


def retrieval_query_text(objective: Column, concept: Column) -> Column:
    """The objective, and the concept behind it unless it is inside already."""
    inside = F.contains(F.lower(objective), F.lower(F.trim(concept)))
    return F.when(F.trim(concept).eqNullSafe("") | concept.isNull() | inside, objective).otherwise(F.concat_ws(" ", objective, F.trim(concept)))


def display_labels(refs: DataFrame) -> DataFrame:
    """``title · Page n · section`` of what is there; a page only if the range is one page."""
    page = F.when(F.col("start_page") == F.col("end_page"), F.concat(F.lit("Page "), F.col("start_page").cast("string")))
    return refs.withColumn("label", F.concat_ws(" · ", F.col("title"), page, F.nullif(F.trim("section"), F.lit(""))))


def materialize_references(packages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, label) rows of the packages' chunks."""
    rows = packages.select("query_id", F.explode("chunk_ids").alias("chunk_id"))
    refs = rows.join(chunks.select("chunk_id", F.col("material_id").alias("title"), "start_page", "end_page", F.col("node_id").alias("section")), "chunk_id")
    return display_labels(refs).select("query_id", "chunk_id", "label")


def linked_visuals(selected: DataFrame, links: DataFrame, visuals: DataFrame) -> DataFrame:
    """Visuals linked to chosen chunks, both ends in the same material."""
    return selected.join(links, "chunk_id").join(visuals.withColumnRenamed("material_id", "__m"), "visual_id").where(F.col("__m") == F.col("material_id")).select("query_id", "chunk_id", "visual_id").distinct()


def foreign_hits(hits: DataFrame, chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """Hits whose chunk isn't the query owner's: empty if isolation holds."""
    return hits.join(owners, "query_id").join(chunks.select("chunk_id", F.col("owner_id").alias("__o")), "chunk_id").where(~F.col("owner_id").eqNullSafe(F.col("__o"))).select("query_id", "chunk_id")
