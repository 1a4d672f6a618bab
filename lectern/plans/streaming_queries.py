"""Registered queries of streams and sources, with the SQL of their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import columns
from lectern.functions.storage import shared_folder
from lectern.operators import chunking as ch
from lectern.operators import retrieval as re_
from lectern.plans import carriers as c
from lectern.sources import committed as co
from lectern.sources import readers
from lectern.sources import word_tables as wt
from lectern.streaming import state as st
from lectern.streaming import timers as tm


def _events(spark, sf):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    return st.read_events(spark, sf).select(
        "event_id", F.col("user_id").alias("mission_id"), (k % 5).alias("concept"), "ts", F.when(kind == "purchase", "CORRECT").when(kind == "click", "PARTIAL").when(kind == "error", "INCORRECT").alias("outcome"),
        F.concat(F.lit("provider-"), (F.col("user_id") % 2).cast("string")).alias("provider"), F.concat(F.lit("task-"), (k % 5).cast("string")).alias("task"), F.when(kind == "error", "FAILED").otherwise("SUCCEEDED").alias("status"), kind.alias("event_type"))


def _progress(spark, sf):
    i = F.col("event_id")
    stage = F.element_at(F.array(*map(F.lit, c.STAGES)), (F.get_json_object("props", "$.k").cast("long") % 6 + 1).cast("int"))
    return st.read_events(spark, sf).select(F.col("user_id").alias("job_id"), "event_id", "ts", stage.alias("stage"), (i % 7).alias("current"), F.when(i % 50 == 0, 0).otherwise(7).alias("total"))


def _ingest(spark, sf):
    """Documents one by one as materials of their own, in two runs, the second over all again."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = st.read_table(spark, sf, "documents")

    def chunks(batch):
        pages = batch.select(F.col("doc_id").cast("string").alias("material_id"), F.lit(1).cast("long").alias("page_number"), F.lit("NATIVE").alias("extraction_method"), F.col("text").alias("content"))
        located = pages.select("material_id", "page_number", F.concat(F.col("material_id"), F.lit("/r")).alias("node_id"))
        return ch.chunk_documents(pages, located).select("chunk_id", "material_id", "chunk_index", "content")

    st.stream_ingest(docs.where("doc_id % 2 = 0"), chunks, f"{folder}/chunks", ["chunk_id"], f"{folder}/state-0")
    st.stream_ingest(docs, chunks, f"{folder}/chunks", ["chunk_id"], f"{folder}/state-1")
    return spark.read.parquet(f"{folder}/chunks").select("chunk_id", "material_id", "chunk_index", "content")


def _golden(spark, sf):
    """Benchmark items written as one golden file, every document that holds an item being expected for it, and read again."""
    d, b = c.table(spark, sf, "documents").select("doc_id", "text"), c.table(spark, sf, "benchmark")
    none = F.array().cast("array<string>")
    met = re_.literal_match(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    expected = met.groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("expected"))
    cases = b.join(expected, F.col("item_id") == F.col("query_id"), "left").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("s").alias("subject"), F.lit("d").alias("difficulty"), F.array(F.lit(1.0)).alias("vector"), F.coalesce("expected", none).alias("expected"), F.array(F.lit("0")).alias("acceptable"), none.alias("irrelevant"))
    folder = f"{shared_folder(spark)}/golden-{uuid.uuid4().hex}"
    empty = F.from_json(F.lit("[]"), "array<struct<id:string,content:string,section:string,vector:array<double>>>")
    cases.agg(F.lit("v1").alias("version"), F.collect_list(F.struct(*cases.columns)).alias("cases")).select("version", "cases", empty.alias("corpus")).coalesce(1).write.json(folder)
    return readers.read_golden(spark, folder)[2]


def _word_table(spark, sf):
    """The words of documents written as a word table and read again."""
    lines = c.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.filter(F.split("t", "[\\s\"]+"), lambda x: x != "")).alias("k", "word"))
    zero = lambda *names: [F.lit(0).alias(n) for n in names]
    table = words.select(F.lit(5).alias("level"), F.col("doc_id").cast("int").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (F.col("line") + 1).alias("line_num"), (F.col("k") + 1).alias("word_num"), *zero("left", "top", "width", "height"), (F.length("word") % 100).cast("double").alias("conf"), F.col("word").alias("text"))
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    table.write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(folder)
    return readers.read_ocr_words(spark, folder).groupBy("page_num", "line_num").agg(F.count("*").alias("words"), F.sum("conf").cast("long").alias("signs"))


def _delimited(spark, sf):
    columns.register(spark)
    text = c.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("\t")).alias("text"))
    return spark.sql("SELECT doc_id, r.line_no, array_join(r.cells, '|') AS cells FROM {t}, LATERAL delimited_rows(text) AS r", t=text)


def _word_files(spark, sf):
    """The words of documents as word tables of a thousand pages each, in order, read and checked file by file.

    Texts are dealt and put in order, not words: a text's lines of the table are one value.
    """
    docs = c.table(spark, sf, "documents").where(F.col("text").rlike('[^\\s"]')).select("doc_id", "text", F.floor(F.col("doc_id") / 1000).alias("part"))
    first = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) == 1
    page = F.coalesce((F.col("doc_id") + 1).cast("string"), F.lit(""))
    row = lambda line, w, k: F.concat(line, (k + 1).cast("string"), F.lit("\t0\t0\t0\t0\t"), (F.length(w) % 100).cast("string"), F.lit("\t"), w)
    of_line = lambda t, n: F.transform(F.regexp_extract_all(t, F.lit('[^\\s"]+'), F.lit(0)), lambda w, k: row(F.concat(F.lit("5\t"), page, F.lit("\t1\t1\t"), n.cast("string"), F.lit("\t")), w, k))
    rows = F.array_join(F.flatten(F.transform(F.split("text", "\n"), of_line)), "\n")
    head = F.when(F.col("first"), F.lit("\t".join(wt.NAMES) + "\n")).otherwise(F.lit(""))
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    docs.withColumn("first", first).sortWithinPartitions("part", "doc_id").select(F.concat(head, rows).alias("row"), "part").write.partitionBy("part").option("zlib.compress.level", "BEST_SPEED").text(folder, compression="gzip")
    read = wt.read_word_tables(spark, folder, most_rows=1 << 40, most_chars=1 << 30, task_bytes=8 << 20)
    return read.groupBy((F.col("page_num") - 1).cast("long").alias("doc_id"), "line_num").agg(F.count("*").alias("words"), F.sum("conf").cast("long").alias("signs"))


def _committed(spark, sf):
    """Documents in three batches, one of which comes twice."""
    docs = c.table(spark, sf, "documents")
    folder = f"{shared_folder(spark)}/committed-{uuid.uuid4().hex}"
    for number in (0, 1, 1, 2):
        co.append_committed(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == number), folder, number)
    return co.read_committed(spark, folder)


QUERIES = {
    "read_golden": _golden,
    "read_ocr_words": _word_table,
    "read_word_tables": _word_files,
    "append_committed": _committed,
    "delimited_rows": _delimited,
    "stream_evidence": lambda s, d: st.run_to_end(st.stream_evidence(_events(s, d)), "complete"),
    "stream_streaks": lambda s, d: st.latest(st.run_to_end(st.stream_streaks(_events(s, d)), "append"), ["mission_id", "concept"], "seen"),
    "stream_throttle": lambda s, d: st.run_to_end(st.stream_throttle(_events(s, d).withColumnRenamed("mission_id", "address"), 2, 6 * 3600), "append"),
    "stale_jobs": lambda s, d: st.stale_jobs(c.k_jobs(s, d), "2024-01-30 12:00:00"),
    "stream_stale_jobs": lambda s, d: st.run_to_end(tm.stream_stale_jobs(_events(s, d).select(F.col("mission_id").alias("job_id"), "ts"), 12 * 3600, "1 hour"), "append", timers=True).select("job_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen")),
    "silences": lambda s, d: tm.silences(c.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts")), 12 * 3600, 3600).select("job_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen")),
    "stream_job_progress": lambda s, d: st.run_to_end(tm.stream_job_progress(_progress(s, d)), "append", timers=True),
    "stream_sessions": lambda s, d: st.run_to_end(st.study_sessions(st.read_events(s, d), "user_id", late="10 minutes"), "append"),
    "stream_usage": lambda s, d: st.run_to_end(st.stream_usage(_events(s, d)), "complete"),
    "study_sessions": lambda s, d: st.study_sessions(c.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id"),
    "stream_dedup": lambda s, d: st.run_to_end(st.stream_dedup(_events(s, d).unionByName(_events(s, d)), ["event_id"]), "append").select("event_id", "mission_id"),
    "stream_job_state": lambda s, d: st.run_to_end(st.stream_job_state(_events(s, d).withColumnsRenamed({"mission_id": "job_id", "task": "stage"})), "complete"),
    "stream_ingest": _ingest,
    "sniff_content": lambda s, d: readers.sniff_content(c.table(s, d, "pages"), F.when(F.col("page_id") % 7 == 0, F.lit("")).when(F.col("page_id") % 7 == 1, F.lit("%PDF-1.7 x")).when(F.col("page_id") % 7 == 2, F.lit("plain")).otherwise(F.col("html")), F.when(F.col("page_id") % 2 == 0, "text/html; charset=utf-8").otherwise("application/pdf"), 4000).select("page_id", "detected", "kind", "reason"),
}

#: Silences of more than twelve hours that are over, or that end before the newest time less one hour (in milliseconds).
SILENT = "WITH e AS (SELECT user_id AS job_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM (SELECT DISTINCT user_id, ts FROM events)), m AS (SELECT epoch_ms(max(ts)) - 3600000 AS mark FROM events) SELECT job_id, ts AS last_seen FROM e, m WHERE CASE WHEN next IS NOT NULL THEN next - ts > INTERVAL 12 HOUR ELSE (epoch_us(ts) + 43200000000) // 1000 + 1 <= mark END"
PROGRESS = "CASE WHEN event_id % 50 = 0 THEN 100 ELSE floor((event_id % 7) * 10000.0::DOUBLE / 7) / 100 END"
SESSIONS = "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, n"

ORACLE_SQL = {
    "read_golden": "SELECT item_id::VARCHAR AS query_id, 'EXPECTED' AS grade, doc_id::VARCHAR AS chunk_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) UNION ALL SELECT item_id::VARCHAR, 'ACCEPTABLE', '0' FROM benchmark",
    "read_word_tables": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_num FROM documents), w AS (SELECT doc_id, line_num, unnest(list_filter(string_split_regex(t, '[\s\"]+'), lambda x: x <> '')) AS word FROM l) SELECT doc_id, line_num::INT AS line_num, count(*) AS words, sum(length(word) % 100)::BIGINT AS signs FROM w GROUP BY ALL",
    "append_committed": "SELECT * FROM documents",
    "read_ocr_words": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_num FROM documents), w AS (SELECT doc_id, line_num, unnest(list_filter(string_split_regex(t, '[\s\"]+'), lambda x: x <> '')) AS word FROM l) SELECT doc_id::INT AS page_num, line_num::INT AS line_num, count(*) AS words, sum(length(word) % 100)::BIGINT AS signs FROM w GROUP BY 1, 2",
    "delimited_rows": "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, ', ', chr(9)), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), c AS (SELECT doc_id, line_no, [trim(x, ' ' || chr(13) || chr(11) || chr(12)) FOR x IN CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) ELSE string_split(trim(trim(line), '|'), '|') END] AS cells FROM l WHERE contains(line, chr(9)) <> contains(line, '|')) SELECT doc_id, line_no, array_to_string(cells, '|') AS cells FROM c WHERE len(cells) >= 2 AND NOT list_contains(cells, '')",
    "stream_evidence": c.sql("k_attempts", "SELECT mission_id, concept, count(*) AS attempts, max(CASE outcome WHEN 'CORRECT' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END)::BIGINT AS best FROM k_attempts WHERE outcome IS NOT NULL GROUP BY 1, 2"),
    "stream_streaks": c.sql("k_attempts", "WITH k AS (SELECT *, max(sequence) FILTER (outcome = 'CORRECT') OVER (PARTITION BY mission_id, concept) AS last FROM k_attempts WHERE outcome IS NOT NULL) SELECT mission_id, concept, count(*) AS seen, count(*) FILTER (last IS NULL OR sequence > last) AS failures FROM k GROUP BY 1, 2"),
    "stale_jobs": "SELECT user_id AS job_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 60 SECOND < TIMESTAMP '2024-01-30 12:00:00'",
    "stream_stale_jobs": SILENT,
    "silences": SILENT,
    "stream_job_progress": c.sql("k_jobs", f"SELECT job_id, event_id, stage, max({PROGRESS}) OVER w AS progress, max({PROGRESS}) OVER v AS stage_progress FROM k_jobs WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id), v AS (PARTITION BY job_id, stage ORDER BY ts, event_id)"),
    "stream_sessions": SESSIONS + " HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "stream_usage": c.sql("k_requests", "SELECT provider, task, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS requests, count(*) FILTER (status = 'FAILED') AS failures FROM k_requests GROUP BY 1, 2, 3"),
    "study_sessions": SESSIONS,
    "stream_dedup": "SELECT event_id, user_id AS mission_id FROM events",
    "stream_job_state": "SELECT user_id AS job_id, CASE WHEN arg_max(event_type, {'t': ts, 'e': event_id}) = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, 'task-' || arg_max((props::JSON->>'k')::BIGINT % 5, {'t': ts, 'e': event_id}) AS stage, count(*) AS rows FROM events GROUP BY 1",
    "sniff_content": "WITH b AS (SELECT page_id, page_id % 7 AS m, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/pdf' END AS said, strlen(CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1.7 x' WHEN 2 THEN 'plain' ELSE html END) AS n FROM pages), t AS (SELECT *, CASE WHEN m IN (0, 2) THEN NULL WHEN m = 1 THEN 'application/pdf' ELSE 'text/html' END AS detected FROM b) SELECT page_id, detected, CASE detected WHEN 'application/pdf' THEN 'DOCUMENT' WHEN 'text/html' THEN 'WEB_PAGE' END AS kind, CASE WHEN n = 0 THEN 'EMPTY' WHEN n > 4000 THEN 'TOO_LARGE' WHEN detected IS NULL THEN 'UNKNOWN' WHEN detected <> said THEN 'MISMATCH' END AS reason FROM t",
}
