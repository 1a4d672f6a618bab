"""Running state over event streams; each form equals a batch form over the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.storage import shared_folder


@contextmanager
def _with_timers(spark: SparkSession) -> Iterator[None]:
    """Inside, queries start with the state store that value state, map state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_batch(batch: DataFrame, folder: str, number: int) -> None:
    """Writes a batch under its number; the same batch again replaces what it wrote before."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_to_end(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], DataFrame] | None = None, timers: bool = False, folder: str | None = None) -> DataFrame:
    """Runs a query over all rows that are there now, and reads what it wrote to the shared folder.

    In ``complete`` mode the last result replaces the ones before it, else rows are
    added, each batch in a folder of its own, so that a batch that runs again after
    a failure adds nothing twice. With a ``folder`` of before the query goes on
    from there. ``timers`` for operators with timers or map state.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = {}

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        schema["s"] = out.schema
        write_batch(out, f"{folder}/rows", 0 if mode == "complete" else number)

    with _with_timers(spark) if timers else nullcontext():
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    known = schema.get("s", stream.schema)
    try:
        return spark.read.schema(known).parquet(f"{folder}/rows").select(known.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], known)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a file stream, be it a file or a folder of files, whatever these are called."""
    # a stream can't begin at a single file, but a pattern in the path meets files and folders
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a file stream with event time."""
    stream = read_table(spark, folder, name)
    schema = stream.schema
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def stream_evidence(events: DataFrame) -> DataFrame:
    """(mission_id, concept, attempts, best) so far; for complete or update mode."""
    return events.where("outcome is not null").groupBy("mission_id", "concept").agg(F.count("*").alias("attempts"), F.max(F.when(F.col("outcome") == "CORRECT", 2).when(F.col("outcome") == "PARTIAL", 1).otherwise(0)).cast("long").alias("best"))


def stream_streaks(events: DataFrame) -> DataFrame:
    """(mission_id, concept, seen, failures) at each update: failures since the last CORRECT. Rows of a batch go by time."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, failures = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for outcome in rows["outcome"]:
            failures = 0 if outcome == "CORRECT" else failures + 1
        seen += len(rows)
        state.update((seen, failures))
        yield pd.DataFrame({"mission_id": [key[0]], "concept": [key[1]], "seen": [seen], "failures": [failures]})

    known = events.where("outcome is not null")
    return known.groupBy("mission_id", "concept").applyInPandasWithState(step, "mission_id long, concept long, seen long, failures long", "seen long, failures long", "append", GroupStateTimeout.NoTimeout)


def stream_throttle(events: DataFrame, cap: int, seconds: int) -> DataFrame:
    """(event_id, allowed): at most ``cap`` events of an address in a window that opens with its first event.

    A denied event neither counts nor extends the window; the first event after its end opens the next.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].astype("int64") // 1000 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].astype("datetime64[us]").astype("int64"):
            if opened is None or t >= opened + seconds * 1_000_000:
                opened, used = int(t), 0
            ok = used < cap
            used += ok
            allowed.append(ok)
        state.update((opened, used))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    return events.groupBy("address").applyInPandasWithState(step, "event_id long, allowed boolean", "opened long, used int", "append", GroupStateTimeout.NoTimeout)


def stale_jobs(jobs: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """(job_id, last_seen) of jobs without a sign of life for so long."""
    last = jobs.groupBy("job_id").agg(F.max("ts").alias("last_seen"))
    return last.where(F.col("last_seen") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)")) < F.lit(now).cast("timestamp_ntz"))


def stream_usage(requests: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(provider, task, day, requests, failures) in windows of event time; rows later than ``late`` may be dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = requests.withWatermark("ts", late).groupBy(w.alias("w"), "provider", "task").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "FAILED").alias("failures"))
    return g.select("provider", "task", F.col("w.start").cast("timestamp_ntz").alias("day"), "requests", "failures")


def study_sessions(events: DataFrame, user: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user, started, events): sessions that end after a gap; for batch and stream.

    As a stream it needs ``late``: a session is given out once, in append mode, when
    the watermark has passed its end; until then later rows lengthen it or join two
    of them, also over batches. Rows older than the watermark are dropped.
    """
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").cast("timestamp_ntz").alias("started"), "events")


def stream_dedup(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_job_state(jobs: DataFrame) -> DataFrame:
    """(job_id, status, stage, rows): the state of each job by its newest row."""
    newest = F.max(F.struct("ts", "event_id", "status", "stage"))
    return jobs.groupBy("job_id").agg(newest.alias("n"), F.count("*").alias("rows")).select("job_id", "n.status", "n.stage", "rows")


#: Folders of a store, by a hash of the material, so that a batch reads only those it touches.
BUCKETS = 64


def ingest_once(existing: DataFrame | None, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks that aren't stored yet; a stored one with another content is an error row (state CONFLICT)."""
    from lectern.operators.integrity import append_or_verify

    if existing is None:
        return chunks.withColumn("state", F.lit("NEW"))
    return append_or_verify(existing, chunks, keys).where("state <> 'SAME'")


def stream_ingest(stream: DataFrame, make_chunks: Callable[[DataFrame], DataFrame], folder: str, keys: list[str], checkpoint: str, material: str = "material_id") -> None:
    """Adds the chunks of new documents to the table at ``folder``; running a batch twice adds nothing.

    ``make_chunks`` gets the documents of a batch and must name each chunk by its
    document alone (a document is never split over batches), so that batches give
    the same chunks as one run over all. The store is kept in folders by a hash of
    ``material``, and a batch reads those of its own materials. Chunks whose key is
    stored with another content go to ``folder`` + "-conflicts", under the number of
    the batch, so that a batch that runs again reports them once.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(material), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        chunks = make_chunks(batch).withColumn("bucket", bucket)
        touched = [r.bucket for r in chunks.select("bucket").distinct().collect()]
        try:
            existing = spark.read.schema(chunks.schema).parquet(folder).where(F.col("bucket").isin(touched))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = None
        fresh = ingest_once(existing, chunks, keys).persist()
        fresh.where("state = 'NEW'").drop("state").write.mode("append").partitionBy("bucket").parquet(folder)
        write_batch(fresh.where("state <> 'NEW'").drop("state", "bucket"), f"{folder}-conflicts", number)
        fresh.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest update of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
