"""A table that grows by numbered batches: each is there once and as a whole, or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

#: The column that carries a row's hash to the writer; it isn't stored.
HASH = "__row_hash"


class BatchConflict(ValueError):
    """A batch came again with other rows."""


@dataclass
class Part(WriterCommitMessage):
    """A file that one task wrote, its rows and the sum of their hashes."""

    file: str | None
    rows: int
    total: int


class _Log:
    """The list of batches: one small file for each, with the names of its data files."""

    def __init__(self, uri: str):
        self.system, self.root = fs.FileSystem.from_uri(uri)

    def _path(self, number: int) -> str:
        return f"{self.root}/_batches/{number:020d}.json"

    def write_part(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """Rows of one task in a file of a new name, so that a task that runs again or twice harms nothing."""
        name, writer, rows, total = f"{uuid.uuid4().hex}.parquet", None, 0, 0
        try:
            for b in batches:
                place = b.schema.get_field_index(HASH)
                total = (total + int(np.add.reduce(b.column(place).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), dtype=np.uint64))) % 2**64
                b = pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != place], schema=b.schema.remove(place))
                if writer is None:
                    self.system.create_dir(f"{self.root}/data")
                    writer = pq.ParquetWriter(f"{self.root}/data/{name}", b.schema, filesystem=self.system)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Part(name if writer is not None else None, rows, total)

    def read(self, number: int) -> dict | None:
        if self.system.get_file_info(self._path(number)).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(self._path(number)) as f:
            return json.loads(f.read())

    def drop(self, parts: list[Part | None]) -> None:
        for p in parts:
            if p is not None and p.file is not None:
                self.system.delete_file(f"{self.root}/data/{p.file}")

    def commit(self, number: int, parts: list[Part | None], schema: str) -> None:
        """Makes the files the batch ``number``. If it is there with the same rows they go again; with others it is an error."""
        parts = [p for p in parts if p is not None]
        entry = {"rows": sum(p.rows for p in parts), "hash": sum(p.total for p in parts) % 2**64, "schema": schema, "files": [p.file for p in parts if p.file]}
        old = self.read(number)
        if old is not None:
            self.drop(parts)
            if (old["rows"], old["hash"]) != (entry["rows"], entry["hash"]):
                raise BatchConflict(f"batch {number} has {old['rows']} rows and came again with other ones ({entry['rows']})")
            return
        self.system.create_dir(f"{self.root}/_batches")
        new = f"{self.root}/_batches/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(new) as f:
            f.write(json.dumps(entry).encode())
        self.system.move(new, self._path(number))

    def entries(self) -> list[dict]:
        infos = self.system.get_file_info(fs.FileSelector(f"{self.root}/_batches", allow_not_found=True))
        return [self.read(int(i.base_name[:-5])) for i in sorted(infos, key=lambda i: i.path) if i.base_name.endswith(".json")]


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, number: int, schema: str):
        self.uri, self.number, self.schema = uri, number, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return _Log(self.uri).write_part(iterator)

    def commit(self, messages: list[Part | None]) -> None:
        _Log(self.uri).commit(self.number, messages, self.schema)

    def abort(self, messages: list[Part | None]) -> None:
        _Log(self.uri).drop(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, uri: str, schema: str):
        self.uri, self.schema = uri, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return _Log(self.uri).write_part(iterator)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        _Log(self.uri).commit(batchId, messages, self.schema)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        _Log(self.uri).drop(messages)


class CommittedTable(DataSource):
    """The sink of ``append_committed`` and ``stream_committed``."""

    @classmethod
    def name(cls) -> str:
        return "committed_table"

    def _stored(self, schema: StructType) -> str:
        return StructType([f for f in schema.fields if f.name != HASH]).json()

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], int(self.options["batch"]), self._stored(schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self._stored(schema))


def _hashed(df: DataFrame) -> DataFrame:
    df.sparkSession.dataSource.register(CommittedTable)
    return df.withColumn(HASH, F.xxhash64(*df.columns))


def append_committed(df: DataFrame, folder: str, batch: int) -> None:
    """Adds the rows as the batch ``batch``. The same batch again adds nothing; with other rows it raises ``BatchConflict``.

    Tasks write files of new names, which count only once the driver has listed
    them, so rows of failed, repeated or speculative tasks are never read. Batches
    are compared by their number of rows and the sum of the rows' 64-bit hashes.
    Columns of maps can't be hashed and are refused.
    """
    _hashed(df).write.format("committed_table").option("batch", batch).mode("append").save(folder)


def stream_committed(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds each of its batches, over all rows that are there now, in the manner of ``append_committed``."""
    return _hashed(stream).writeStream.format("committed_table").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_committed(spark: SparkSession, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """All rows of the batches that are there, read by Spark's own Parquet reader; a table without rows needs the ``schema``."""
    log = _Log(folder)
    entries = log.entries()
    if schema is None:
        if not entries:
            raise FileNotFoundError(f"no batch in {folder}")
        schema = StructType.fromJson(json.loads(entries[0]["schema"]))
    files = [f"{folder.rstrip('/')}/data/{f}" for e in entries for f in e["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
