"""Tables written between jobs to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.storage import shared_folder

__all__ = ["discard", "free_names", "shared_folder", "stored", "without_shuffles"]


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes a job's shuffle files as soon as its result is written, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads them from there: lineage ends here.

    The table's folder is added to ``made``, for ``discard`` after the last read.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.option("compression", "zstd").parquet(folder)
    if made is not None:
        made.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes tables of the shared folder that nothing will read again."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a name that no column of the table has, in whatever case: columns can be added without a clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out
