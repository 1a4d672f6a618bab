"""State with timers: jobs that fall silent, and progress that never falls.

Both keep their state in the state store (value and map state) and need its
RocksDB provider, which ``run_to_end(..., timers=True)`` sets for the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Silence(StatefulProcessor):
    """Keeps the last sign of life; a timer goes off when the event time is ``seconds`` past it."""

    def __init__(self, seconds: float):
        self.gap = round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, reported boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, reported = self.last.get() if self.last.exists() else (None, False)
        before, silent = at, []
        for t in sorted(x for f in rows for x in _micros(f["ts"])):
            if at is not None and t <= at:  # older than what is known: says nothing new
                continue
            if at is not None and t - at > self.gap and not reported:
                silent.append(at)
            at, reported = t, False
        if at != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(at))
            self.last.update((at, reported))
        yield self._rows(key, silent)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, reported = self.last.get()
        due = not reported and self._due(at) <= expiredTimerInfo.getExpiryTimeInMs()
        if due:
            self.last.update((at, True))
        yield self._rows(key, [at] if due else [])

    def close(self) -> None:
        pass

    def _due(self, at: int) -> int:
        """The first millisecond that is past the gap."""
        return (at + self.gap) // 1000 + 1

    @staticmethod
    def _rows(key: Any, silent: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]] * len(silent), "last_seen": pd.Series(silent, dtype="int64").astype("datetime64[us]")})


def stream_stale_jobs(signs: DataFrame, seconds: float = 60, late: str = "10 minutes") -> DataFrame:
    """(job_id, last_seen): each silence of more than ``seconds`` of event time, reported once.

    A report comes when the watermark, ``late`` behind the newest row of all jobs,
    has passed the end of the time allowed, or when the job's next row shows the
    silence first; that row revives the job. ``signs``: (job_id, ts); rows older
    than the watermark are dropped, and a row older than the job's last one tells
    nothing. State: a time and a flag a job, and one timer. For append mode.
    """
    marked = signs.where("ts is not null").select("job_id", "ts").withWatermark("ts", late)
    kind = dict(signs.dtypes)["job_id"]
    return marked.groupBy("job_id").transformWithStateInPandas(_Silence(seconds), f"job_id {kind}, last_seen timestamp", "Append", "EventTime")


def silences(signs: DataFrame, seconds: float = 60, late_seconds: float = 600) -> DataFrame:
    """The batch form of ``stream_stale_jobs``: the silences that are over, and those that the watermark has passed."""
    newest = signs.agg(F.unix_micros(F.max("ts"))).first()[0]
    mark = (newest or 0) // 1000 - round(late_seconds * 1000)
    w = Window.partitionBy("job_id").orderBy("ts")
    at, after = F.unix_micros("ts"), F.unix_micros("next")
    gap = round(seconds * 1_000_000)
    rows = signs.where("ts is not null").select("job_id", "ts").distinct().withColumn("next", F.lead("ts").over(w))
    over = F.when(F.col("next").isNotNull(), after - at > gap).otherwise(F.floor((at + gap) / 1000) + 1 <= mark)
    return rows.where(over).select("job_id", F.col("ts").alias("last_seen"))


class _Progress(StatefulProcessor):
    """The best progress of a job as a value, and of each of its stages in a map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "progress double")
        self.stages = handle.getMapState("stages", "stage string", "progress double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = self.best.get()[0] if self.best.exists() else 0.0
        log = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        known: dict[str, float] = {}
        out = []
        for event, stage, now in zip(log["event_id"], log["stage"], log["now"]):
            stage = stage or ""
            if stage not in known:
                known[stage] = self.stages.getValue((stage,))[0] if self.stages.containsKey((stage,)) else 0.0
            best, known[stage] = max(best, now), max(known[stage], now)
            out.append((key[0], event, stage, best, known[stage]))
        self.best.update((best,))
        for stage, value in known.items():
            self.stages.updateValue((stage,), (value,))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "stage", "progress", "stage_progress"])

    def close(self) -> None:
        pass


def stream_job_progress(log: DataFrame) -> DataFrame:
    """(job_id, event_id, stage, progress, stage_progress) for each row of a log: percentages that never fall, over all batches.

    ``log``: (job_id, event_id, ts, stage, current, total); 100 where the total is
    0, cut to two places. The rows of a batch go by time and id; a row that comes
    in a later batch counts from there on. A null stage is the empty one.
    """
    now = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.floor(F.col("current") * 10000.0 / F.col("total")) / 100)
    rows = log.select("job_id", "event_id", "ts", "stage", now.alias("now"))
    kinds = dict(log.dtypes)
    schema = f"job_id {kinds['job_id']}, event_id {kinds['event_id']}, stage string, progress double, stage_progress double"
    return rows.groupBy("job_id").transformWithStateInPandas(_Progress(), schema, "Append", "None")
