"""Stand-ins for the document and learner tables, made from the given test tables.

Each carrier is a DataFrame here and a SQL text in ``CTE`` for the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "[^\\s]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_pages(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Documents as the pages of one material for each source; with ``only`` (doc_id), the texts of other documents are null, so they aren't sorted along."""
    docs = table(spark, sf, "documents")
    if only is not None:
        wanted = only.select("doc_id", F.lit(True).alias("__wanted")).distinct()
        docs = docs.join(wanted, "doc_id", "left").withColumn("text", F.when(F.col("__wanted"), F.col("text"))).drop("__wanted")
    order = Window.partitionBy("source").orderBy("doc_id")
    scanned = F.col("doc_id") % 5 == 0
    return docs.select(
        "doc_id",
        F.col("source").alias("material_id"),
        F.row_number().over(order).cast("long").alias("page_number"),
        F.when(scanned, "OCR").otherwise("NATIVE").alias("extraction_method"),
        F.when(scanned, F.element_at(F.array(*map(F.lit, ("STRONG", "LIMITED", "POOR"))), (F.col("doc_id") % 3 + 1).cast("int"))).alias("quality"),
        F.col("text").alias("content"),
        "lang",
    )


def k_lines(spark: SparkSession, sf: str) -> DataFrame:
    return k_pages(spark, sf).select("doc_id", "material_id", "page_number", "extraction_method", "quality", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def k_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A root, a chapter for each ten pages and a section for each five, by material."""
    pages = k_pages(spark, sf).groupBy("material_id").agg(F.max("page_number").alias("n"))
    m, n = F.col("material_id"), F.col("n")
    root = pages.select("material_id", F.concat(m, F.lit("/r")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("DOCUMENT").alias("node_type"), m.alias("title"), F.lit(1).cast("long").alias("ordinal"), F.lit(1).cast("long").alias("start_page"), n.alias("end_page"), F.lit(0).cast("long").alias("depth"))

    def level(step: int, letter: str, kind: str, parent, depth: int, ordinal) -> DataFrame:
        cut = pages.select("material_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step))).alias("k"))
        return cut.select(
            "material_id",
            F.concat(m, F.lit(letter), F.col("k").cast("string")).alias("node_id"),
            parent.alias("parent_id"),
            F.lit(kind).alias("node_type"),
            F.concat(F.lit(kind.title() + " "), F.col("k").cast("string")).alias("title"),
            ordinal.cast("long").alias("ordinal"),
            (F.col("k") * step + 1).alias("start_page"),
            F.least(F.col("k") * step + step, n).alias("end_page"),
            F.lit(depth).cast("long").alias("depth"),
        )

    chapters = level(10, "/c", "CHAPTER", F.concat(m, F.lit("/r")), 1, F.col("k") + 1)
    sections = level(5, "/s", "SECTION", F.concat(m, F.lit("/c"), F.floor(F.col("k") / 2).cast("string")), 2, F.col("k") % 2 + 1)
    return root.unionByName(chapters).unionByName(sections)


def k_chunks(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """One chunk for each document; with ``only`` (chunk_id), other chunks have no content."""
    p = k_pages(spark, sf, only if only is None else only.select(F.col("chunk_id").alias("doc_id")))
    return p.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("material_id"),
        (F.col("page_number") - 1).alias("chunk_index"),
        F.col("page_number").alias("start_page"),
        F.col("page_number").alias("end_page"),
        F.concat(F.col("material_id"), F.lit("/s"), F.floor((F.col("page_number") - 1) / 5).cast("string")).alias("node_id"),
        "content",
        F.coalesce("quality", F.lit("STRONG")).alias("quality"),
        (F.col("doc_id") % 11 != 0).alias("is_active"),
        F.col("lang").alias("owner_id"),
    )


def k_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items: the first sentence is the query, the whole item tells the expected chunks; every fifth query is of another owner."""
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(i.alias("query_id"), F.regexp_extract("text", "^[^.]+", 0).alias("query"), F.col("text").alias("probe"), F.when(i % 5 == 4, "fr").otherwise("en").alias("owner_id"))


def k_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a learner's activities: mission, sequence, concept and outcome."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return (
        table(spark, sf, "events")
        .select(
            "event_id",
            F.col("user_id").alias("mission_id"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.row_number().over(w).cast("long").alias("sequence"),
            (F.get_json_object("props", "$.k").cast("long") % 5).alias("concept"),
            F.when(kind == "purchase", "CORRECT").when(kind == "click", "PARTIAL").when(kind == "error", "INCORRECT").alias("outcome"),
            kind.alias("event_type"),
            "value",
        )
        .withColumn("activity", F.element_at(F.array(*map(F.lit, ("UNDERSTAND", "RETRIEVE", "CONNECT", "APPLY"))), (F.col("sequence") % 4 + 1).cast("int")))
        .withColumn("difficulty", F.element_at(F.array(*map(F.lit, ("FOUNDATIONAL", "INTERMEDIATE", "APPLIED"))), (F.col("event_id") % 3 + 1).cast("int")))
        .withColumn("template", F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("t"), (F.col("event_id") % 9).cast("string"))))
        .withColumn("question_intent", F.when(F.col("activity") != "UNDERSTAND", F.concat(F.lit("q"), (F.col("event_id") % 2).cast("string"))))
    )


def k_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("provider-"), (F.col("user_id") % 2).cast("string")).alias("provider"),
        F.concat(F.lit("task-"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")).alias("task"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.col("value").alias("latency"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") % 900 + 20).alias("tokens"),
        ((F.col("event_id") % 40) / 8).alias("cost"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 3).otherwise(0).cast("long").alias("retries"),
    )


#: The stages of a job, in order (fixed values).
STAGES = ("EXTRACT", "STRUCTURE", "VISUALS", "TABLES", "NORMALIZE", "CHUNK")


def k_jobs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.element_at(F.array(*map(F.lit, STAGES)), (F.get_json_object("props", "$.k").cast("long") % 6 + 1).cast("int")).alias("stage"),
        F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").when(kind == "click", "RUNNING").when(kind == "view", "PENDING").otherwise("RETRY").alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value"),
        (F.col("event_id") % 4 + 1).alias("attempt"),
    )


CTE = {
    "k_pages": """SELECT doc_id, source AS material_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number,
  CASE WHEN doc_id % 5 = 0 THEN 'OCR' ELSE 'NATIVE' END AS extraction_method,
  CASE WHEN doc_id % 5 = 0 THEN ['STRONG','LIMITED','POOR'][doc_id % 3 + 1] END AS quality, text AS content, lang FROM documents""",
    "k_lines": """SELECT doc_id, material_id, page_number, extraction_method, quality,
  generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no, unnest(string_split(content, chr(10))) AS line FROM k_pages""",
    "k_nodes": """SELECT material_id, material_id || '/r' AS node_id, NULL::VARCHAR AS parent_id, 'DOCUMENT' AS node_type, material_id AS title, 1::BIGINT AS ordinal, 1::BIGINT AS start_page, max(page_number) AS end_page, 0::BIGINT AS depth FROM k_pages GROUP BY material_id
 UNION ALL SELECT material_id, material_id || '/c' || k, material_id || '/r', 'CHAPTER', 'Chapter ' || k, k + 1, k * 10 + 1, least(k * 10 + 10, n), 1
  FROM (SELECT material_id, n, unnest(range(0, (n - 1) // 10 + 1)) AS k FROM (SELECT material_id, max(page_number) AS n FROM k_pages GROUP BY material_id))
 UNION ALL SELECT material_id, material_id || '/s' || k, material_id || '/c' || (k // 2), 'SECTION', 'Section ' || k, k % 2 + 1, k * 5 + 1, least(k * 5 + 5, n), 2
  FROM (SELECT material_id, n, unnest(range(0, (n - 1) // 5 + 1)) AS k FROM (SELECT material_id, max(page_number) AS n FROM k_pages GROUP BY material_id))""",
    "k_chunks": """SELECT doc_id AS chunk_id, material_id, page_number - 1 AS chunk_index, page_number AS start_page, page_number AS end_page,
  material_id || '/s' || ((page_number - 1) // 5) AS node_id, content, coalesce(quality, 'STRONG') AS quality, doc_id % 11 <> 0 AS is_active, lang AS owner_id FROM k_pages""",
    "k_queries": r"""SELECT item_id AS query_id, regexp_extract(text, '^[^.]+') AS query, text AS probe, CASE WHEN item_id % 5 = 4 THEN 'fr' ELSE 'en' END AS owner_id FROM benchmark""",
    "k_attempts": """SELECT *, ['UNDERSTAND','RETRIEVE','CONNECT','APPLY'][sequence % 4 + 1] AS activity, ['FOUNDATIONAL','INTERMEDIATE','APPLIED'][event_id % 3 + 1] AS difficulty,
  CASE WHEN event_id % 5 > 0 THEN 't' || (event_id % 9) END AS template, CASE WHEN sequence % 4 > 0 THEN 'q' || (event_id % 2) END AS question_intent FROM (
  SELECT event_id, user_id AS mission_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, (props::JSON->>'k')::BIGINT % 5 AS concept,
  CASE event_type WHEN 'purchase' THEN 'CORRECT' WHEN 'click' THEN 'PARTIAL' WHEN 'error' THEN 'INCORRECT' END AS outcome, event_type, value FROM events)""",
    "k_requests": """SELECT event_id, 'provider-' || (user_id % 2) AS provider, 'task-' || ((props::JSON->>'k')::BIGINT % 5) AS task,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, value AS latency, ts,
  event_id % 900 + 20 AS tokens, (event_id % 40) / 8 AS cost, CASE WHEN event_type = 'error' THEN event_id % 3 ELSE 0 END AS retries FROM events""",
    "k_jobs": """SELECT event_id, user_id AS job_id, ['EXTRACT','STRUCTURE','VISUALS','TABLES','NORMALIZE','CHUNK'][(props::JSON->>'k')::BIGINT % 6 + 1] AS stage,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'PENDING' ELSE 'RETRY' END AS status, ts, value, event_id % 4 + 1 AS attempt FROM events""",
}
_NEEDS = {"k_lines": ["k_pages"], "k_nodes": ["k_pages"], "k_chunks": ["k_pages"]}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the carriers it names before it."""
    wanted: list[str] = []
    for n in names.split():
        for x in [*_NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in wanted)
    body = body.strip()
    rest = body[5:] if body[:5].upper() == "WITH " else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (f", {rest}" if rest else f" {body}")
