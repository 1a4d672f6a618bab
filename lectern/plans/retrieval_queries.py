"""Registered queries of retrieval and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.storage import stored
from lectern.operators import evaluation as ev
from lectern.operators import retrieval as re_
from lectern.operators import vectors as vx
from lectern.plans import carriers as c

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}\p{{M}}]+')"


def _vec_queries(spark, sf):
    return c.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _misspelt(spark, sf) -> DataFrame:
    """The queries with the second and third sign of every word of five letters or more exchanged."""
    return c.k_queries(spark, sf).withColumn("query", F.regexp_replace("query", "\\b(\\p{L})(\\p{L})(\\p{L})(?=\\p{L}{2})", "$1$3$2"))


def _visual_links(spark, sf) -> DataFrame:
    """Each embedding stands for a figure of the chunk with its number."""
    e = c.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") + 100000).alias("visual_id"), (F.col("label") + 1).cast("long").alias("page_number"), F.when(F.col("label") < 6, "SUPPORTED").when(F.col("label") < 8, "LIMITED").otherwise("FAILED").alias("status"))


VISUALS = "visuals AS (SELECT vec_id AS chunk_id, vec_id + 100000 AS visual_id, (label + 1)::BIGINT AS page_number, CASE WHEN label < 6 THEN 'SUPPORTED' WHEN label < 8 THEN 'LIMITED' ELSE 'FAILED' END AS status FROM embeddings)"
LEX = r"""alt AS (SELECT query_id, unnest(string_split_regex(lower(query), '\s+or\s+')) AS text, generate_subscripts(string_split_regex(lower(query), '\s+or\s+'), 1) AS part FROM k_queries),
 aw AS (SELECT DISTINCT query_id, part, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}\p{M}]+')) AS token FROM alt),
 qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{Nd}\p{M}]+'))) AS token, len(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{Nd}\p{M}]+'))) AS n FROM k_queries),
 post AS (SELECT chunk_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{Nd}\p{M}]+') AS t FROM k_chunks)),
 met AS (SELECT DISTINCT query_id, n, chunk_id, token, pos FROM qt JOIN post USING (token)),
 hits AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, part, chunk_id FROM aw JOIN (SELECT DISTINCT query_id, chunk_id, token FROM met) USING (query_id, token) JOIN (SELECT query_id, part, count(*) AS n FROM aw GROUP BY 1, 2) USING (query_id, part) GROUP BY query_id, part, chunk_id, n HAVING count(*) = n)),
 ok AS (SELECT query_id, chunk_id, chunk_index FROM k_queries q JOIN k_chunks k ON k.is_active AND k.owner_id = q.owner_id),
 ends AS (SELECT m.query_id, m.chunk_id, m.pos AS fin, (SELECT min(last) FROM (SELECT max(x.pos) AS last FROM met x WHERE x.query_id = m.query_id AND x.chunk_id = m.chunk_id AND x.pos <= m.pos GROUP BY x.token)) AS start,
   (SELECT count(DISTINCT x.token) FROM met x WHERE x.query_id = m.query_id AND x.chunk_id = m.chunk_id AND x.pos <= m.pos) AS seen, m.n FROM met m SEMI JOIN hits USING (query_id, chunk_id)),
 density AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (fin - start + 1)), 6) AS rank FROM (SELECT query_id, chunk_id, start, min(fin) AS fin FROM ends WHERE seen = n GROUP BY ALL) GROUP BY ALL),
 literal AS (SELECT query_id, chunk_id FROM k_queries JOIN k_chunks ON contains(lower(content), lower(query))),
 lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rank DESC, chunk_index, chunk_id) AS rank_no FROM (
   SELECT query_id, chunk_id, chunk_index, l.chunk_id IS NOT NULL AS exact, coalesce(rank, 0) AS rank FROM (SELECT * FROM hits UNION SELECT * FROM literal) h JOIN ok USING (query_id, chunk_id) LEFT JOIN (SELECT query_id, chunk_id FROM literal) l USING (query_id, chunk_id) LEFT JOIN density USING (query_id, chunk_id))) WHERE rank_no <= 10)"""
TRIGRAMS = "flatten(list_transform(" + TOK + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"
#: Where windows end that are looked at from the beginning of each block of 16 trigrams on.
_ENDS = (16, 24, 36, 54, 80, 120, 180, 270, 400, 600)


def _alike() -> str:
    """SQL for the similarity of a query with the best stretch of a text: its shared trigrams by all of both.

    ``alike`` has the pairs that reach ``bar``: 0.6, and for pairs found by words or
    literally (which need their value in any case) that of a stretch of wanted trigrams.
    A stretch of that similarity that begins in a block and ends before a window's end
    has no more wanted ones than the window, and at most 15 distinct ones less than the
    window before it; blocks without such a window hold no beginning. The others are walked.
    """
    blocks = f"unnest(range(greatest((prev + 15) // 16, (pos - {_ENDS[-1] + 1}) // 16 + 1, 0), (pos - 1) // 16 + 1)) AS b"
    count = lambda x: ", ".join(f"count(*) FILTER (pos <= b * 16 + {end}) AS {x}{k}" for k, end in enumerate(_ENDS, 1))
    less = lambda k: f"d{k} - 15" if k else "-15"
    reach = ", ".join(f"CASE WHEN s{k + 1} >= bar / (1 + bar) * (n + greatest({less(k)}, 0)) - 1e-6 AND {less(k)} <= n / bar THEN {end} END" for k, end in enumerate(_ENDS))
    return rf"""found AS MATERIALIZED (SELECT query_id, chunk_id, chunk_index, l.chunk_id IS NOT NULL AS exact, coalesce(rank, 0) AS rank FROM (SELECT * FROM hits UNION SELECT * FROM literal) h JOIN ok USING (query_id, chunk_id) LEFT JOIN (SELECT query_id, chunk_id FROM literal) l USING (query_id, chunk_id) LEFT JOIN density USING (query_id, chunk_id)
   QUALIFY rank() OVER (PARTITION BY query_id ORDER BY exact DESC, rank DESC) <= 10),
 qg AS MATERIALIZED (SELECT query_id, owner_id, len(g) AS n, unnest(g) AS gram FROM (SELECT query_id, owner_id, list_distinct({TRIGRAMS.format("query")}) AS g FROM k_queries)),
 cg AS (SELECT chunk_id, owner_id, unnest(g) AS gram, generate_subscripts(g, 1) AS pos FROM (SELECT chunk_id, owner_id, {TRIGRAMS.format("content")} AS g FROM k_chunks WHERE is_active AND owner_id IN (SELECT owner_id FROM k_queries))),
 cp AS MATERIALIZED (SELECT *, coalesce(lag(pos) OVER (PARTITION BY chunk_id, gram ORDER BY pos), 0) AS prev FROM cg),
 place AS MATERIALIZED (SELECT query_id, n, chunk_id, gram, pos, prev FROM qg JOIN cp USING (owner_id, gram)),
 island AS (SELECT query_id, chunk_id, n, count(DISTINCT gram) AS d FROM (SELECT query_id, chunk_id, n, gram, pos - row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS island FROM place SEMI JOIN found USING (query_id, chunk_id)) GROUP BY query_id, chunk_id, n, island),
 pair AS (SELECT query_id, chunk_id, n, 0.6::DOUBLE - 1e-6 AS bar FROM place ANTI JOIN found USING (query_id, chunk_id) GROUP BY query_id, chunk_id, n HAVING count(DISTINCT gram) >= 0.6 * n - 1e-6 UNION ALL SELECT query_id, chunk_id, n, max(d)::DOUBLE / n FROM island GROUP BY query_id, chunk_id, n),
 length AS (SELECT chunk_id, max(pos) AS most FROM cp GROUP BY chunk_id),
 size AS (SELECT chunk_id, b, most, {count("d")} FROM (SELECT chunk_id, pos, most, {blocks} FROM cp JOIN length USING (chunk_id)) GROUP BY chunk_id, b, most),
 held AS (SELECT query_id, chunk_id, n, bar, b, {count("s")} FROM (SELECT query_id, chunk_id, n, bar, pos, {blocks} FROM place JOIN pair USING (query_id, chunk_id, n)) GROUP BY query_id, chunk_id, n, bar, b),
 live AS (SELECT query_id, chunk_id, b, least(b * 16 + reach, most) AS upto FROM (SELECT *, greatest({reach}, CASE WHEN most > b * 16 + {_ENDS[-1]} AND {less(len(_ENDS))} <= n / bar THEN most END) AS reach FROM held JOIN size USING (chunk_id, b)) WHERE reach IS NOT NULL),
 begins AS (SELECT query_id, chunk_id, n, pos AS start, upto FROM (SELECT *, (pos - 1) // 16 AS b FROM place QUALIFY lag(pos) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) IS DISTINCT FROM pos - 1) JOIN live USING (query_id, chunk_id, b)),
 walk AS (SELECT query_id, chunk_id, n, start, unnest(range(start, upto + 1)) AS pos FROM begins),
 stretch AS (SELECT query_id, chunk_id, n, count(*) OVER w AS d, count(*) FILTER (wanted) OVER w AS s FROM (SELECT w.*, q.gram IS NOT NULL AS wanted FROM walk w JOIN cp USING (chunk_id, pos) LEFT JOIN qg q ON q.query_id = w.query_id AND q.gram = cp.gram WHERE prev < start) WINDOW w AS (PARTITION BY query_id, chunk_id, start ORDER BY pos)),
 alike AS (SELECT query_id, chunk_id, round(max(s / (n + d - s)), 6) AS similarity FROM stretch GROUP BY query_id, chunk_id)"""


# what is found by words or literally, and what is alike by trigrams
WHOLE = LEX + ", " + _alike() + """,
 whole AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rank DESC, trigram DESC, chunk_index, chunk_id) AS rank_no FROM (
   SELECT query_id, chunk_id, chunk_index, exact, rank, coalesce(similarity, 0) AS trigram FROM found LEFT JOIN alike USING (query_id, chunk_id)
   UNION ALL SELECT query_id, chunk_id, chunk_index, false, 0, similarity FROM alike JOIN ok USING (query_id, chunk_id) ANTI JOIN found USING (query_id, chunk_id) WHERE similarity >= 0.6)) WHERE rank_no <= 10)"""
VEC = """sims AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
 vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank_no FROM sims) WHERE rank_no <= 10)"""
SCOPED = """scoped AS (SELECT query_id, vec_id, similarity, rank_no FROM (SELECT s.query_id // 20 AS query_id, s.vec_id, similarity, row_number() OVER (PARTITION BY s.query_id ORDER BY similarity DESC, chunk_index, vec_id) AS rank_no FROM sims s JOIN ok ON ok.query_id = s.query_id // 20 AND ok.chunk_id = s.vec_id) WHERE rank_no <= 10)"""
# the vector channel of benchmark query i are the neighbours of vector 20 i
FUSED = LEX + ", " + VEC + ", " + SCOPED + """, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_no FROM (
  SELECT query_id, chunk_id, min(lr) AS lexical_rank, min(vr) AS vector_rank, round(coalesce(1.0::DOUBLE / (60 + min(lr)), 0) + coalesce(1.0::DOUBLE / (60 + min(vr)), 0), 9) AS score FROM (
    SELECT query_id, chunk_id, rank_no AS lr, NULL::BIGINT AS vr FROM lexical UNION ALL SELECT query_id, vec_id, NULL, rank_no FROM scoped) GROUP BY 1, 2)
  QUALIFY rank_no <= 10)"""
FUSED_WHOLE = FUSED.replace(LEX, WHOLE).replace("FROM lexical UNION", "FROM whole UNION")


def lexical(spark, sf, similarity: float | None = None):
    """With ``similarity`` also by trigrams, as in ``WHOLE``; the SQL of the queries built on this one has no such branch."""
    return re_.lexical_search(c.k_queries(spark, sf), c.k_chunks(spark, sf), similarity=similarity)


def vector(spark, sf):
    return re_.vector_search(_vec_queries(spark, sf), c.table(spark, sf, "embeddings"))


def scoped(spark, sf):
    """Each embedding stands for the chunk of its number; benchmark query i asks with vector 20 i, for chunks of its owner."""
    chunks = c.k_chunks(spark, sf).where("is_active").select(F.col("chunk_id").alias("vec_id"), "chunk_index", "owner_id")
    vectors = c.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumn("query_id", F.floor(F.col("vec_id") / 20)).join(c.k_queries(spark, sf).select("query_id", "owner_id"), "query_id")
    return re_.vector_search(asked, vectors.join(chunks, "vec_id"), by=["owner_id"], tie="chunk_index")


def fused(spark, sf, similarity: float | None = None):
    """Ten hits a query at most, so they are written: what is joined with them needn't be shuffled, and they are found once."""
    return stored(re_.hybrid_fuse(lexical(spark, sf, similarity), scoped(spark, sf).select("query_id", F.col("vec_id").alias("chunk_id"), "rank_no")), "hits")


def _ranked(spark, sf, hits=None):
    hits = fused(spark, sf) if hits is None else hits
    k = c.k_chunks(spark, sf, only=hits).select("chunk_id", "quality", "node_id", "content", "material_id")
    return hits.join(k, "chunk_id").withColumnRenamed("node_id", "section")


RANKED = FUSED + ", ranked AS (SELECT f.*, quality, node_id AS section, content, material_id FROM fused f JOIN k_chunks USING (chunk_id))"


def _judged(spark, sf, hits=None):
    """Expected: holds the later passage; acceptable: same section as the query's number; irrelevant: OCR pages of poor quality."""
    q, k = c.k_queries(spark, sf), c.k_chunks(spark, sf)
    probe = q.select("query_id", F.col("probe").alias("query"))
    expected = re_.literal_match(probe, k).withColumn("grade", F.lit("EXPECTED"))
    rest = (fused(spark, sf) if hits is None else hits).join(k, "chunk_id").join(expected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    other = rest.select("query_id", "chunk_id", F.when(F.col("quality") == "POOR", "IRRELEVANT").otherwise("ACCEPTABLE").alias("grade")).where((F.col("grade") == "IRRELEVANT") | (F.col("chunk_id") % 2 == 0))
    return expected.unionByName(other).join(k.select("chunk_id", F.col("node_id").alias("section")), "chunk_id")


JUDGED = RANKED + """, expected AS (SELECT query_id, chunk_id, 'EXPECTED' AS grade FROM k_queries JOIN k_chunks ON contains(lower(content), lower(probe))),
 judged AS (SELECT j.*, node_id AS section FROM (SELECT * FROM expected UNION ALL SELECT query_id, chunk_id, CASE WHEN quality = 'POOR' THEN 'IRRELEVANT' ELSE 'ACCEPTABLE' END FROM ranked ANTI JOIN expected USING (query_id, chunk_id) WHERE quality = 'POOR' OR chunk_id % 2 = 0) j JOIN k_chunks USING (chunk_id))"""
METRICS = JUDGED + """, per AS (SELECT r.query_id, count(*) FILTER (grade = 'EXPECTED' AND rank_no <= 1) AS e1, count(*) FILTER (grade = 'EXPECTED' AND rank_no <= 3) AS e3, count(*) FILTER (grade = 'EXPECTED' AND rank_no <= 5) AS e5,
  count(*) FILTER (grade IN ('EXPECTED','ACCEPTABLE') AND rank_no <= 1) AS a1, count(*) FILTER (grade IN ('EXPECTED','ACCEPTABLE') AND rank_no <= 3) AS a3, count(*) FILTER (grade IN ('EXPECTED','ACCEPTABLE') AND rank_no <= 5) AS a5,
  min(rank_no) FILTER (grade = 'EXPECTED') AS first, coalesce(bool_or(s.section IS NOT NULL) FILTER (rank_no <= 3), false) AS sec, count(*) FILTER (grade = 'IRRELEVANT' AND rank_no <= 3) AS bad, count(*) FILTER (rank_no <= 3) AS shown
  FROM ranked r LEFT JOIN (SELECT query_id, chunk_id, grade FROM judged) j USING (query_id, chunk_id) LEFT JOIN (SELECT DISTINCT query_id, section FROM judged WHERE grade = 'EXPECTED') s ON s.query_id = r.query_id AND s.section = r.section GROUP BY r.query_id),
 metrics AS (SELECT q.query_id, round(coalesce(e1 / n, 0), 9) AS recall_1, round(coalesce(e3 / n, 0), 9) AS recall_3, round(coalesce(e5 / n, 0), 9) AS recall_5,
  round(coalesce(a1 / 1, 0), 9) AS precision_1, round(coalesce(a3 / 3, 0), 9) AS precision_3, round(coalesce(a5 / 5, 0), 9) AS precision_5, round(coalesce(1.0::DOUBLE / first, 0), 9) AS mrr, coalesce(sec, false)::INT::DOUBLE AS section_hit,
  round(CASE WHEN shown > 0 THEN bad / shown ELSE 0 END, 9) AS irrelevant_rate FROM k_queries q LEFT JOIN per USING (query_id) LEFT JOIN (SELECT query_id, count(DISTINCT chunk_id) AS n FROM expected GROUP BY 1) USING (query_id))"""


def metrics(spark, sf):
    hits = fused(spark, sf)  # used twice below
    return stored(ev.retrieval_metrics(_ranked(spark, sf, hits), _judged(spark, sf, hits), c.k_queries(spark, sf)), "metrics")


def _golden(spark, sf):
    """Golden data with faults: blank queries, queries of an owner without chunks, a fifth of the chunks gone, spoilt vectors, a version gone and materials gone."""
    q, at = c.k_queries(spark, sf), F.col("query_id")
    queries = q.withColumns({"query": F.when(at % 7 == 0, " ").otherwise(F.col("query")), "owner_id": F.when(at % 9 == 0, "nobody").otherwise(F.col("owner_id"))})
    corpus = c.k_chunks(spark, sf).where("chunk_id % 5 > 0")
    sources = c.table(spark, sf, "documents").select(F.col("source").alias("material_id")).distinct()
    versions = sources.where("material_id <> 'src5'").withColumn("version_id", F.col("material_id"))
    return ev.golden_violations(queries, stored(_judged(spark, sf), "judged"), corpus, 64, _spoilt(spark, sf), 5, c.k_nodes(spark, sf).withColumnRenamed("material_id", "version_id"), versions, sources.where("material_id not like '%7'"))


def _spoilt(spark, sf):
    """Vectors of which some are missing, short, not finite or zero; their generation is the label, their model now and then another one."""
    at, v = F.col("vec_id") % 11, F.col("embedding")
    bad = F.when(at == 3, F.slice(v, 1, 10)).when(at == 4, F.transform(v, lambda x: x * 0)).when(at == 2, F.transform(v, lambda x, i: F.when(i == 7, F.lit("NaN").cast("float")).otherwise(x))).when(at != 5, v)
    model = (F.col("label") + F.when(F.col("vec_id") % 13 == 0, 1).otherwise(0)) % 2
    return c.table(spark, sf, "embeddings").select("vec_id", "label", F.when(at.isin(2, 3, 4, 5), bad).otherwise(v).alias("embedding"), F.col("label").alias("generation"), F.concat(F.lit("m"), model.cast("string")).alias("model"))


def _generations(spark, sf):
    """A generation for each label but one; one has another size."""
    g = c.table(spark, sf, "embeddings").select(F.col("label").alias("generation")).distinct().where("generation <> 6")
    return g.select("generation", F.concat(F.lit("m"), (F.col("generation") % 2).cast("string")).alias("model"), F.when(F.col("generation") == 5, 32).otherwise(64).alias("dimension"))


def _channel(spark, sf):
    """Queries in every state of the vector channel, told by label and by what ``_spoilt`` did."""
    at = F.col("label")
    return _spoilt(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding", at.alias("scope_size"), (at - 1).alias("generations"), (at != 2).alias("provider"), (at == 3).alias("failed"), F.lit("m").alias("model"), F.when(at == 4, "other").otherwise("m").alias("generation_model"))


def _answers(spark, sf):
    """Assistant turns with the user turn before them."""
    t = c.table(spark, sf, "conversations")
    user = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    words = F.slice(F.split("prompt", " "), 1, 2)
    return t.where("role = 'assistant'").join(user, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("output"), "prompt", F.array_join(words, " ").alias("concept"), F.substring("text", 1, 12).alias("expected"),
        F.concat(F.lit("p"), (F.col("conv_id") % 2).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("conv_id") % 6).cast("string")).alias("model"), F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")).alias("task"))


ANSWERS = """answers AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS output, u.text AS prompt, array_to_string(string_split(u.text, ' ')[1:2], ' ') AS concept, substring(a.text, 1, 12) AS expected, 'p' || (a.conv_id % 2) AS provider, 'm' || (a.conv_id % 6) AS model, 't' || (a.turn % 3) AS task
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant')"""
FORBIDDEN = ["idiot", "###"]
SEM = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"
MATCH = "(len(p) > 0 AND len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p AND NOT list_has_any(t[greatest(i - 3, 1):i - 1], ['no', 'not', 'never', 'without']))) > 0)"
RESULTS = ANSWERS + ", toks AS (SELECT *, " + SEM.format("output") + " AS t, " + SEM.format("concept") + " AS p FROM answers)" + rf""", results AS (SELECT id, provider, model, task, array_to_string(list_filter([
  CASE WHEN contains(lower(output), 'idiot') OR contains(lower(output), '###') THEN 'FORBIDDEN_TERM' END, CASE WHEN length(trim(expected)) > 0 AND contains(lower(prompt), lower(trim(expected))) THEN 'ANSWER_LEAK' END,
  CASE WHEN len(list_filter(string_split_regex(trim(output), '\s+'), lambda x: x <> '')) > 120 THEN 'TOO_LONG' END, CASE WHEN trim(output) = '' THEN 'BLANK' END, CASE WHEN NOT {MATCH} THEN 'CONCEPT_MISSING' END], lambda x: x IS NOT NULL), ',') AS failed FROM toks)"""


def _results(spark, sf):
    return ev.evaluate_outputs(_answers(spark, sf), FORBIDDEN, 120)


def _packages(spark, sf):
    q = c.k_queries(spark, sf)
    ranked = stored(_ranked(spark, sf), "ranked")
    return re_.build_evidence(re_.retrieval_quality(ranked, q), ranked, _visual_links(spark, sf), 3, 2)


PACKAGES = RANKED + ", " + VISUALS + """, quality_of AS (SELECT query_id, CASE WHEN bool_or(r.query_id IS NOT NULL AND quality IN ('LIMITED','POOR')) THEN 'LIMITED' WHEN count(r.chunk_id) = 0 THEN 'INSUFFICIENT' ELSE 'STRONG' END AS retrieval_quality FROM k_queries q LEFT JOIN ranked r USING (query_id) GROUP BY query_id),
 chosen AS (SELECT * FROM ranked WHERE rank_no <= 3), seen AS (SELECT query_id, visual_id, page_number, status, min(rank_no) AS first_rank FROM chosen JOIN visuals USING (chunk_id) GROUP BY ALL),
 usable AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, page_number, visual_id) AS n FROM seen WHERE status IN ('SUPPORTED','LIMITED')),
 packages AS (SELECT query_id, retrieval_quality,
  coalesce((SELECT list(chunk_id ORDER BY rank_no) FROM chosen x WHERE x.query_id = q.query_id), []) AS chunk_ids, coalesce((SELECT list(visual_id ORDER BY n) FROM usable x WHERE x.query_id = q.query_id AND n <= 2), []) AS visual_ids,
  list_filter([CASE WHEN (SELECT max(rank_no) > 3 FROM ranked x WHERE x.query_id = q.query_id) THEN 'CHUNK_BUDGET_APPLIED' END,
   CASE WHEN (SELECT bool_or(quality = 'LIMITED') FROM chosen x WHERE x.query_id = q.query_id) THEN 'LIMITED_CHUNK_SOURCE_QUALITY' END, CASE WHEN (SELECT bool_or(quality = 'POOR') FROM chosen x WHERE x.query_id = q.query_id) THEN 'POOR_CHUNK_SOURCE_QUALITY' END,
   CASE WHEN (SELECT bool_or(status = 'LIMITED' AND n <= 2) FROM usable x WHERE x.query_id = q.query_id) THEN 'LIMITED_VISUAL_INTERPRETATION' END, CASE WHEN (SELECT count(*) > 0 FROM seen x WHERE x.query_id = q.query_id AND status = 'FAILED') THEN 'VISUAL_EXCLUDED_BY_INTERPRETATION_STATUS' END,
   CASE WHEN (SELECT max(n) > 2 FROM usable x WHERE x.query_id = q.query_id) THEN 'VISUAL_BUDGET_APPLIED' END, CASE WHEN retrieval_quality = 'INSUFFICIENT' THEN 'INSUFFICIENT_EVIDENCE' END], lambda x: x IS NOT NULL) AS limitations FROM quality_of q)"""


def _flat(df):
    return df.select("query_id", "retrieval_quality", *[F.array_join(F.transform(k, lambda x: x.cast("string")), ",").alias(k) for k in ("chunk_ids", "visual_ids", "limitations")])


FLAT = "SELECT query_id, retrieval_quality, array_to_string(chunk_ids, ',') AS chunk_ids, array_to_string(visual_ids, ',') AS visual_ids, array_to_string(limitations, ',') AS limitations FROM packages"


def _targets(spark, sf):
    return c.k_nodes(spark, sf).where("depth > 0").select(F.element_at(F.split("node_id", "/"), 2).alias("topic"), "material_id", F.when(F.col("depth") == 2, F.col("node_id")).alias("node_id")).withColumn("topic", F.substring("topic", 2, 1))


TARGETS = "targets AS (SELECT substring(string_split(node_id, '/')[2], 2, 1) AS topic, material_id, CASE WHEN depth = 2 THEN node_id END AS node_id FROM k_nodes WHERE depth > 0)"
SCOPES = TARGETS + ", scopes AS (SELECT topic, material_id, bool_or(node_id IS NULL) AS whole, CASE WHEN bool_or(node_id IS NULL) THEN [] ELSE list_sort(list_distinct(list(node_id))) END AS nodes FROM targets GROUP BY 1, 2)"


def _scopes(spark, sf):
    return re_.build_scope(_targets(spark, sf))


def _frozen(spark, sf):
    s = _scopes(spark, sf)
    other = s.select("topic", "material_id", (F.length("material_id") == 4).alias("whole"), F.filter("nodes", lambda x: ~x.endswith("s1")).alias("nodes"))
    return re_.freeze_scope(s, other)


def _scope_rows(spark, sf):
    return c.k_nodes(spark, sf).where("depth = 2 and start_page > 5").select("material_id", F.when(F.length("material_id") == 5, F.col("node_id")).alias("node_id"))


def _baseline(m):
    """The measures against themselves with half the cases gone and some values moved."""
    old = m.where("query_id % 2 = 0").withColumn("mrr", F.round(F.col("mrr") + (F.col("query_id") % 4) / 100, 9))
    return ev.baseline_diff(ev.melt_metrics(m, ["query_id"]), ev.melt_metrics(old, ["query_id"]), ["query_id"])


def _violated(spark, sf):
    """Quality labels as measures: the baseline has another version, a case less and one more, and values out of range."""
    n = c.table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.lit("v1").alias("version"), F.explode(F.array(F.lit(1), F.lit(3))).alias("k"), F.lit("recall").alias("metric"), (F.col("quality") / 2).alias("value"))
    other = F.when(F.col("query_id") % 50 == 0, F.lit(1.5)).when(F.col("query_id") % 51 == 0, F.lit(None)).otherwise(F.col("value"))
    base = n.withColumns({"version": F.lit("v2"), "value": other, "query_id": F.when(F.col("query_id") % 40 == 3, -F.col("query_id")).otherwise(F.col("query_id"))}).where("k = 1")
    return ev.baseline_violations(base, n)


QUERIES = {
    "lexical_search": lambda s, d: lexical(s, d, 0.6),
    "vector_search": vector,
    "vector_search_scoped": scoped,
    "hybrid_search": lambda s, d: fused(s, d, 0.6),
    "literal_match": lambda s, d: re_.literal_match(c.k_queries(s, d), c.k_chunks(s, d)),
    "fts_match": lambda s, d: re_.fts_match(c.k_queries(s, d), c.k_chunks(s, d)),
    "cover_density": lambda s, d: re_.cover_density(c.k_queries(s, d), c.k_chunks(s, d)),
    "word_similarity": lambda s, d: re_.word_similarity(_misspelt(s, d), c.k_chunks(s, d)),
    "lexical_search_misspelt": lambda s, d: re_.lexical_search(_misspelt(s, d), c.k_chunks(s, d)),
    "vector_search_approx": lambda s, d: vx.approximate_vector_search(_vec_queries(s, d), c.table(s, d, "embeddings")),
    "embedding_violations": lambda s, d: re_.embedding_violations(_spoilt(s, d).drop("label"), 64),
    "embedding_violations_generations": lambda s, d: re_.embedding_violations(_spoilt(s, d), 0, _generations(s, d)),
    "vector_status": lambda s, d: re_.vector_status(_channel(s, d), 64),
    "missing_embeddings": lambda s, d: re_.missing_embeddings(c.k_chunks(s, d), c.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") % 2).alias("generation")), 1).select("chunk_id", "material_id"),
    "embed_missing": lambda s, d: re_.embed_missing(c.k_chunks(s, d), c.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") % 2).alias("generation")), 1, _length_embedding),
    "inspect_retrieval": lambda s, d: re_.inspect_retrieval(fused(s, d)),
    "dedup_evidence": lambda s, d: re_.dedup_evidence(_ranked(s, d)).select("query_id", "chunk_id", "rank_no"),
    "budget_prefix": lambda s, d: re_.budget_prefix(_ranked(s, d), F.octet_length("content"), 8000).select("query_id", "chunk_id", "rank_no", "used"),
    "retrieval_quality": lambda s, d: re_.retrieval_quality(_ranked(s, d), c.k_queries(s, d)),
    "build_evidence": lambda s, d: _flat(_packages(s, d)),
    "evidence_violations": lambda s, d: re_.evidence_violations(_packages(s, d).withColumn("chunk_ids", F.when(F.col("query_id") % 3 == 0, F.concat("chunk_ids", "chunk_ids")).when(F.col("query_id") % 3 == 1, F.array().cast("array<long>")).otherwise(F.col("chunk_ids")))),
    "materialize_references": lambda s, d: re_.materialize_references(_packages(s, d), c.k_chunks(s, d)),
    "collect_visuals": lambda s, d: re_.collect_visuals(_ranked(s, d), _visual_links(s, d)).withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",")),
    "linked_visuals": lambda s, d: re_.linked_visuals(_ranked(s, d).select("query_id", "chunk_id", "material_id"), _visual_links(s, d).select("chunk_id", "visual_id"), _visual_links(s, d).select("visual_id", F.concat(F.lit("src"), F.col("page_number").cast("string")).alias("material_id"))),
    "retrieval_query_text": lambda s, d: _answers(s, d).select("id", re_.retrieval_query_text(F.col("prompt"), F.when(F.col("id") % 3 == 0, F.col("expected")).when(F.col("id") % 3 == 1, F.col("concept"))).alias("query")),
    "foreign_hits": lambda s, d: re_.foreign_hits(fused(s, d), c.k_chunks(s, d), c.k_queries(s, d).select("query_id", F.lit("en").alias("owner_id"))),
    "authorized_chunks": lambda s, d: re_.authorized_chunks(c.k_chunks(s, d), "en").select("chunk_id", "material_id", "chunk_index"),
    "filter_scope": lambda s, d: re_.filter_scope(c.k_chunks(s, d), _scope_rows(s, d)).select("chunk_id", "node_id"),
    "build_scope": lambda s, d: _scopes(s, d).withColumn("nodes", F.array_join("nodes", ",")),
    "freeze_scope": lambda s, d: _frozen(s, d).withColumn("nodes", F.array_join("nodes", ",")),
    "retrieval_metrics": metrics,
    "baseline_diff": lambda s, d: _baseline(metrics(s, d)),
    "baseline_violations": lambda s, d: _violated(s, d),
    "metrics_summary": lambda s, d: ev.metrics_summary(metrics(s, d).withColumns({"subject": (F.col("query_id") % 3).cast("string"), "difficulty": (F.col("query_id") % 2).cast("string")}), ["subject", "difficulty"], ["recall_3", "precision_3", "mrr"]),
    "golden_violations": _golden,
    "phrase_match": lambda s, d: _answers(s, d).select("id", ev.phrase_match(F.col("output"), F.col("concept")).alias("asserted"), ev.phrase_match(F.col("output"), F.col("concept"), False).alias("mentioned")),
    "output_rules": lambda s, d: ev.output_rules(_answers(s, d), FORBIDDEN, 120).select("id", F.array_join("failed", ",").alias("failed")),
    "near_duplicate_questions": lambda s, d: ev.near_duplicates(c.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")),
    "evaluate_outputs": _results,
    "pass_rates": lambda s, d: ev.pass_rates(_results(s, d)),
    "failed_cases": lambda s, d: ev.failed_cases(_results(s, d)),
}


def _length_embedding(frames):
    """A stand-in for a caller's model: three numbers about the text."""
    for f in frames:
        f["embedding"] = [[float(len(t)), float(t.count(" ")), 1.0] for t in f["content"]]
        yield f


Q = "k_pages k_chunks k_queries"
ORACLE_SQL = {
    "lexical_search": c.sql(Q, f"WITH {WHOLE} SELECT query_id, chunk_id, exact, rank, trigram, rank_no FROM whole"),
    "vector_search": f"WITH {VEC} SELECT query_id, vec_id, similarity, rank_no FROM vector",
    "vector_search_scoped": c.sql(Q, f"WITH {LEX}, {VEC}, {SCOPED} SELECT * FROM scoped"),
    "hybrid_search": c.sql(Q, f"WITH {FUSED_WHOLE} SELECT * FROM fused"),
    "literal_match": c.sql(Q, f"WITH {LEX} SELECT * FROM literal"),
    "fts_match": c.sql(Q, f"WITH {LEX} SELECT * FROM hits"),
    "cover_density": c.sql(Q, f"WITH {LEX} SELECT * FROM density"),
    "embedding_violations": "SELECT vec_id, CASE WHEN vec_id % 11 = 5 THEN 'MISSING' WHEN vec_id % 11 = 3 THEN 'DIMENSION' WHEN vec_id % 11 = 2 THEN 'NOT_FINITE' ELSE 'ZERO_NORM' END AS reason FROM embeddings WHERE vec_id % 11 IN (2, 3, 4, 5)",
    "embedding_violations_generations": "WITH g AS (SELECT label AS generation, 'm' || (label % 2) AS model, CASE WHEN label = 5 THEN 32 ELSE 64 END AS size FROM (SELECT DISTINCT label FROM embeddings) WHERE label <> 6), r AS (SELECT vec_id, CASE WHEN vec_id % 11 = 5 THEN 'MISSING' WHEN g.model IS NULL THEN 'GENERATION' WHEN g.model <> 'm' || (CASE WHEN vec_id % 13 = 0 THEN label + 1 ELSE label END % 2) THEN 'MODEL' WHEN size <> CASE vec_id % 11 WHEN 3 THEN 10 ELSE 64 END THEN 'DIMENSION' WHEN vec_id % 11 = 2 THEN 'NOT_FINITE' WHEN vec_id % 11 = 4 THEN 'ZERO_NORM' END AS reason FROM embeddings LEFT JOIN g ON generation = label) SELECT * FROM r WHERE reason IS NOT NULL",
    "vector_status": "SELECT vec_id AS query_id, CASE WHEN label = 0 THEN 'EMPTY_SCOPE' WHEN label = 1 THEN 'NO_GENERATION' WHEN label = 2 THEN 'NO_PROVIDER' WHEN label = 3 OR vec_id % 11 = 5 THEN 'FAILED' WHEN label = 4 THEN 'INCOMPATIBLE' WHEN vec_id % 11 IN (3, 4) THEN 'INVALID' ELSE 'AVAILABLE' END AS status FROM embeddings",
    "missing_embeddings": c.sql("k_chunks", "SELECT chunk_id, material_id FROM k_chunks WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 1)"),
    "inspect_retrieval": c.sql(Q, f"WITH {FUSED} SELECT query_id, count(*) AS hits, count(lexical_rank) AS lexical_hits, count(vector_rank) AS vector_hits, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank_no) AS \"order\" FROM fused GROUP BY 1"),
    "dedup_evidence": c.sql(Q, f"WITH {RANKED} SELECT query_id, chunk_id, rank_no FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank_no) = 1"),
    "budget_prefix": c.sql(Q, f"WITH {RANKED} SELECT query_id, chunk_id, rank_no, sum(strlen(content)) OVER (PARTITION BY query_id ORDER BY rank_no)::BIGINT AS used FROM ranked QUALIFY used <= 8000"),
    "retrieval_quality": c.sql(Q, f"WITH {PACKAGES} SELECT * FROM quality_of"),
    "build_evidence": c.sql(Q, f"WITH {PACKAGES} {FLAT}"),
    "evidence_violations": c.sql(Q, f"WITH {PACKAGES}, bent AS (SELECT query_id, retrieval_quality, visual_ids, CASE query_id % 3 WHEN 0 THEN list_concat(chunk_ids, chunk_ids) WHEN 1 THEN [] ELSE chunk_ids END AS chunk_ids FROM packages), judged_ AS (SELECT query_id, CASE WHEN retrieval_quality IN ('STRONG','LIMITED') AND len(chunk_ids) = 0 THEN 'NO_CHUNK' WHEN len(chunk_ids) <> len(list_distinct(chunk_ids)) THEN 'REPEATED_CHUNK' WHEN len(visual_ids) > 0 AND len(chunk_ids) = 0 THEN 'VISUAL_WITHOUT_CHUNK' END AS reason FROM bent) SELECT * FROM judged_ WHERE reason IS NOT NULL"),
    "materialize_references": c.sql(Q, f"WITH {PACKAGES} SELECT query_id, chunk_id, material_id || ' · Page ' || start_page || ' · ' || node_id AS label FROM (SELECT query_id, unnest(chunk_ids) AS chunk_id FROM packages) JOIN k_chunks USING (chunk_id)"),
    "collect_visuals": c.sql(Q, f"WITH {RANKED}, {VISUALS} SELECT query_id, visual_id, page_number, status, min(rank_no) AS first_rank, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_ids FROM ranked JOIN visuals USING (chunk_id) GROUP BY 1, 2, 3, 4"),
    "linked_visuals": c.sql(Q, f"WITH {RANKED}, {VISUALS} SELECT DISTINCT query_id, chunk_id, visual_id FROM ranked JOIN visuals USING (chunk_id) WHERE 'src' || page_number = material_id"),
    "retrieval_query_text": f"WITH {ANSWERS}, x AS (SELECT id, prompt, CASE id % 3 WHEN 0 THEN expected WHEN 1 THEN concept END AS k FROM answers) SELECT id, CASE WHEN k IS NULL OR trim(k) = '' OR contains(lower(prompt), lower(trim(k))) THEN prompt ELSE prompt || ' ' || trim(k) END AS query FROM x",
    "foreign_hits": c.sql(Q, f"WITH {FUSED} SELECT query_id, chunk_id FROM fused JOIN k_chunks USING (chunk_id) WHERE owner_id IS DISTINCT FROM 'en'"),
    "authorized_chunks": c.sql("k_chunks", "SELECT chunk_id, material_id, chunk_index FROM k_chunks WHERE is_active AND owner_id = 'en'"),
    "filter_scope": c.sql("k_chunks k_nodes", "SELECT chunk_id, node_id FROM k_chunks k WHERE EXISTS (SELECT 1 FROM k_nodes n WHERE depth = 2 AND n.start_page > 5 AND n.material_id = k.material_id AND (length(n.material_id) <> 5 OR n.node_id = k.node_id))"),
    "build_scope": c.sql("k_nodes", f"WITH {SCOPES} SELECT topic, material_id, whole, array_to_string(nodes, ',') AS nodes FROM scopes"),
    "freeze_scope": c.sql("k_nodes", f"WITH {SCOPES}, o AS (SELECT topic, material_id, length(material_id) = 4 AS wb, list_filter(nodes, lambda x: NOT ends_with(x, 's1')) AS nb FROM scopes), b AS (SELECT topic, material_id, whole AND wb AS whole, CASE WHEN whole AND wb THEN [] WHEN whole THEN nb WHEN wb THEN nodes ELSE list_sort(list_intersect(nodes, nb)) END AS nodes FROM scopes JOIN o USING (topic, material_id)) SELECT topic, material_id, whole, array_to_string(nodes, ',') AS nodes FROM b WHERE whole OR len(nodes) > 0"),
    "retrieval_metrics": c.sql(Q, f"WITH {METRICS} SELECT * FROM metrics"),
    "baseline_diff": c.sql(Q, f"WITH {METRICS}, o AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value), b AS (SELECT query_id, metric, CASE WHEN metric = 'mrr' THEN round(value + (query_id % 4) / 100, 9) ELSE value END AS value FROM o WHERE query_id % 2 = 0) SELECT query_id, metric, o.value AS observed, b.value AS baseline, CASE WHEN b.value IS NULL THEN 'NOT_IN_BASELINE' ELSE 'DIFFERENT' END AS kind FROM o LEFT JOIN b USING (query_id, metric) WHERE b.value IS NULL OR abs(o.value - b.value) > 1e-12"),
    "baseline_violations": "WITH b AS (SELECT CASE WHEN doc_id % 40 = 3 THEN -doc_id ELSE doc_id END AS id, CASE WHEN doc_id % 50 = 0 THEN 1.5 WHEN doc_id % 51 = 0 THEN NULL ELSE quality / 2 END AS value FROM labels) SELECT 'VERSION' AS rule, 'v2' AS ref UNION ALL SELECT 'K_VALUES', '1' UNION ALL SELECT DISTINCT 'MISSING_CASE', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT id FROM b) UNION ALL SELECT DISTINCT 'UNKNOWN_CASE', id::VARCHAR FROM b WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'RANGE', id || '.recall' FROM b WHERE value IS NULL OR value NOT BETWEEN 0 AND 1",
    "metrics_summary": c.sql(Q, f"WITH {METRICS}, a AS (SELECT *, (query_id % 3)::VARCHAR AS subject, (query_id % 2)::VARCHAR AS difficulty FROM metrics) SELECT subject, difficulty, count(*) AS cases, round(avg(recall_3), 6) AS recall_3, round(avg(precision_3), 6) AS precision_3, round(avg(mrr), 6) AS mrr FROM a GROUP BY GROUPING SETS ((subject), (difficulty), ())"),
    "golden_violations": c.sql(Q + " k_nodes", f"WITH {JUDGED}, seen AS (SELECT owner_id, count(*) AS n FROM k_chunks WHERE is_active AND chunk_id % 5 > 0 GROUP BY 1) SELECT 'BLANK_QUERY' AS rule, query_id::VARCHAR AS ref FROM k_queries WHERE query_id % 7 = 0 UNION ALL SELECT 'UNKNOWN_CHUNK', chunk_id::VARCHAR FROM judged WHERE chunk_id % 5 = 0 UNION ALL SELECT 'NOTHING_EXPECTED', query_id::VARCHAR FROM k_queries WHERE query_id NOT IN (SELECT query_id FROM expected)"
        " UNION ALL SELECT CASE vec_id % 11 WHEN 2 THEN 'NOT_FINITE' WHEN 4 THEN 'ZERO_VECTOR' ELSE 'DIMENSION' END, vec_id::VARCHAR FROM embeddings WHERE vec_id % 11 IN (2, 3, 4, 5) UNION ALL SELECT 'FEW_CANDIDATES', query_id::VARCHAR FROM k_queries LEFT JOIN seen USING (owner_id) WHERE query_id % 9 = 0 OR coalesce(n, 0) < 5"
        " UNION ALL SELECT DISTINCT 'UNKNOWN_MATERIAL', source FROM documents WHERE source LIKE '%7' AND source <> 'src5' UNION ALL SELECT 'UNKNOWN_VERSION', node_id FROM k_nodes WHERE material_id = 'src5'"),
    "phrase_match": f"WITH {RESULTS} SELECT id, {MATCH} AS asserted, (len(p) > 0 AND len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) > 0) AS mentioned FROM toks",
    "output_rules": f"WITH {RESULTS} SELECT id, replace(replace(failed, ',CONCEPT_MISSING', ''), 'CONCEPT_MISSING', '') AS failed FROM results",
    "evaluate_outputs": f"WITH {RESULTS} SELECT *, failed = '' AS passed FROM results",
    "pass_rates": f"WITH {RESULTS} SELECT provider, model, task, grouping_id(provider, model, task) AS level, count(*) AS cases, count(*) FILTER (failed <> '') AS failed_cases, round(avg((failed = '')::INT), 9) AS pass_rate FROM results GROUP BY CUBE (provider, model, task)",
    "failed_cases": f"WITH {RESULTS} SELECT provider, model, task, id, unnest(string_split(failed, ',')) AS rule FROM results WHERE failed <> ''",
    "near_duplicate_questions": "WITH r AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS text FROM documents), c AS (SELECT text, min(id) AS id FROM r WHERE text <> '' GROUP BY text), w AS (SELECT id, text, list_distinct(list_filter(string_split(text, ' '), lambda x: length(x) >= 3)) AS w FROM c), e AS (SELECT id, unnest(w) AS word FROM w), p AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2) SELECT a, b FROM p JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE n >= 0.75 * (len(x.w) + len(y.w) - n) UNION SELECT x.id, y.id FROM c x JOIN c y ON x.id < y.id AND (contains(x.text, y.text) OR contains(y.text, x.text)) UNION SELECT c.id, r.id FROM r JOIN c USING (text) WHERE r.id <> c.id",
}
