"""Streams over several runs against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import integrity
from lectern.plans import streaming_queries
from lectern.streaming import state, timers

START = dt.datetime(2024, 3, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def runs(spark, tmp_path, parts, schema, make, **options):
    """The rows of a query after each part has been added and run."""
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    out = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = state.run_to_end(make(spark.readStream.schema(schema).parquet(source)), "append", folder=folder, **options)
        out.append(sorted(map(tuple, got.collect())))
    return out


def test_silent_jobs_over_three_runs(spark, tmp_path):
    schema = "job_id long, ts timestamp, other string"
    parts = [
        [(1, at(0), "x"), (1, at(30), "x"), (2, at(10), "x"), (3, at(20), "x"), (3, at(100), None), (4, None, "x")],
        [(2, at(95), "x"), (1, at(300), "x")],  # both were silent and come back
        [(3, at(900), "x"), (2, at(5), "late: dropped"), (1, at(330), "x")],
    ]
    first, second, third = runs(spark, tmp_path, parts, schema, lambda s: timers.stream_stale_jobs(s, 60, "20 seconds"), timers=True)
    assert first == [(2, at(10)), (3, at(20))]  # 3's silence is over, and the watermark, 80, has passed 2's
    assert second == [(1, at(30)), (2, at(10)), (2, at(95)), (3, at(20)), (3, at(100))]
    assert [r for r in third if r not in second] == [(1, at(330))] and len(third) == 6
    kept = [r for p in parts for r in p if r[2] is None or not r[2].startswith("late")]
    assert third == sorted(map(tuple, timers.silences(spark.createDataFrame(kept, schema), 60, 20).collect()))


def test_silences_of_random_jobs(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted((at(rnd.randrange(40_000) + rnd.random()), rnd.randrange(6)) for _ in range(300))
    parts = [[(j, t) for t, j in rows[k : k + 100]] for k in (0, 100, 200)]
    *_, last = runs(spark, tmp_path, parts, "job_id long, ts timestamp", lambda s: timers.stream_stale_jobs(s, 900, "1 minute"), timers=True)
    whole = spark.createDataFrame([r for p in parts for r in p], "job_id long, ts timestamp")
    assert last == sorted(map(tuple, timers.silences(whole, 900, 60).collect())) and len(last) > 50
    assert timers.silences(whole.limit(0)).count() == 0


def test_progress_never_falls_over_three_runs(spark, tmp_path):
    rnd = random.Random(4)
    log = [(rnd.randrange(5), k, at(k), rnd.choice(["A", "B", None]), rnd.randrange(8), rnd.choice([0, 7, 7])) for k in range(240)]
    schema = "job_id long, event_id long, ts timestamp, stage string, current long, total long"
    *_, last = runs(spark, tmp_path, [log[:80], log[80:90], log[90:]], schema, timers.stream_job_progress, timers=True)
    df = spark.createDataFrame(log, schema)
    batch = {(r.job_id, r.event_id): r.progress for r in integrity.job_progress(df).collect()}
    stage = integrity.job_progress(df.withColumn("job_id", F.struct("job_id", F.coalesce("stage", F.lit("")).alias("stage")))).collect()
    stage = {(r.job_id.job_id, r.event_id): r.progress for r in stage}
    assert len(last) == 240 and all((r[3], r[4]) == (batch[r[0], r[1]], stage[r[0], r[1]]) for r in last)


def test_sessions_over_three_runs(spark, tmp_path):
    minutes = [[("a", 0), ("a", 20), ("b", 5)], [("a", 45), ("b", 200), ("b", 215)], [("a", 30), ("b", 400), ("c", 401)]]  # a's 30 in the third run is late: dropped
    parts = [[(u, at(60 * m)) for u, m in p] for p in minutes]
    one, two, three = runs(spark, tmp_path, parts, "user string, ts timestamp", lambda s: state.study_sessions(s, "user", late="10 minutes"))
    assert one == [] and two == [("a", at(0), 3), ("b", at(300), 1)]
    kept = [r for p in parts for r in p if r != ("a", at(1800))]
    whole = state.study_sessions(spark.createDataFrame(kept, "user string, ts timestamp"), "user")
    assert three == sorted(map(tuple, whole.where(F.col("started") < F.lit(at(60 * 370)).cast("timestamp_ntz")).collect())) and len(three) == 3


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, mode):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        state.write_batch(rows, f"file://{tmp_path}/rows", 7)
    assert spark.read.parquet(f"file://{tmp_path}/rows").count() == 2
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, v string").parquet(f"file://{tmp_path}/in")
    counted = stream.groupBy("v").count() if mode == "complete" else stream
    assert state.run_to_end(counted, mode).count() == 2
    assert state.run_to_end(stream.where("k > 5"), "append").count() == 0


def test_a_table_in_a_folder_is_streamed_as_one_in_a_file(spark, tmp_path):
    """the files of a table in a folder have names of their own."""
    docs = spark.createDataFrame([(i, f"Text {i}.", "s") for i in range(9)], "doc_id long, text string, source string").coalesce(1)
    docs.write.parquet(f"file://{tmp_path}/many/documents.parquet")
    (tmp_path / "one").mkdir()
    next((tmp_path / "many/documents.parquet").glob("part*")).rename(tmp_path / "one/documents.parquet")
    docs.write.mode("overwrite").parquet(f"file://{tmp_path}/many/documents.parquet")
    docs.select((F.col("doc_id") + 100).alias("doc_id")).write.parquet(f"file://{tmp_path}/many/other.parquet")
    query = streaming_queries.QUERIES["stream_ingest"]
    one, many = ({(r.material_id, r.content) for r in query(spark, f"file://{tmp_path}/{k}").collect()} for k in ("one", "many"))
    assert one == many == {(str(i), f"Text {i}.") for i in range(9)}
