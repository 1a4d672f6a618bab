"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset, as in tests, a new local folder."""
    name = "spark.checkpoint.dir"
    folder = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{name} must name a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads them from there, which cuts the lineage."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
