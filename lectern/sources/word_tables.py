"""A data source for tables of recognised words, strict in form, read file by file in the tasks."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.sources.readers import WORD_COLUMNS

NAMES = [c.split()[0] for c in WORD_COLUMNS.split(", ")]
#: What a row of a word gives (the level is left out, as it is that of words), and where it stands.
SCHEMA = ", ".join(["file string", "row_no long", *WORD_COLUMNS.split(", ")[1:]])
ARROW = pa.schema([("file", pa.string()), ("row_no", pa.int64()), *((n, pa.int32()) for n in NAMES[1:10]), ("conf", pa.float64()), ("text", pa.string())])
WORD_LEVEL = 5
PLACE = slice(1, 6)
#: Rows of one Arrow batch, and bytes of a file that are looked at together.
BATCH, BLOCK = 8192, 4 << 20
#: Bytes that the number fields of a plain line may have, and what ends or parts fields.
_PLAIN = np.isin(np.arange(256), list(b"0123456789-.\t"))
_TYPES = {n: pa.int32() for n in NAMES[:10]} | {"conf": pa.float64(), "text": pa.string()}


class Malformed(ValueError):
    """A word table that breaks its form."""


@dataclass
class _At:
    """Rows of a table that were read (-1: not even the header), and the place of the last word."""

    number: int = -1
    last: tuple | None = None


def words_of(lines: Iterator[str], file: str, most_rows: int, most_chars: int, at: _At | None = None) -> Iterator[tuple]:
    """The words of one table as rows of ``SCHEMA``, or of its lines behind ``at``; an error names the file and the row.

    The header and the twelve fields must be exact, numbers whole, the confidence of
    a word from -1 to 100 and of anything else -1. Words without text or with the
    confidence -1 are left out; the others must stand in order of page, block,
    paragraph, line and word. Empty lines are skipped, but count for ``most_rows``.
    """
    at = at or _At()
    if at.number < 0:
        header = next(lines, None)
        if header is None or header.rstrip("\r\n").split("\t") != NAMES:
            raise Malformed(f"{file}: another header")
        at.number = 0
    for number, line in enumerate(lines, at.number + 1):
        at.number = number
        where = f"{file}, row {number}"
        if number > most_rows:
            raise Malformed(f"{file}: more than {most_rows} rows")
        line = line.rstrip("\r\n")
        if not line:
            continue
        fields = line.split("\t")
        if len(fields) != len(NAMES) or max(map(len, fields)) > most_chars:
            raise Malformed(f"{where}: fields too many, too few or too long")
        try:
            ints, conf = [int(f) for f in fields[:10]], float(fields[10])
        except ValueError:
            raise Malformed(f"{where}: not a number") from None
        if ints[0] != WORD_LEVEL:
            if conf != -1:
                raise Malformed(f"{where}: a confidence without a word")
            continue
        place, text = tuple(ints[PLACE]), fields[11].strip()
        if place[0] < 1 or place[4] < 1 or min(place) < 0 or not -1 <= conf <= 100:
            raise Malformed(f"{where}: a number out of range")
        if text and conf >= 0:
            if at.last is not None and place <= at.last:
                raise Malformed(f"{where}: a word before its predecessor")
            at.last = place
            yield (file, number, *ints[1:], conf, text)


def plain_words(block: bytes, file: str, most_rows: int, most_chars: int, at: _At) -> pa.RecordBatch | None:
    """What ``words_of`` gives for a block of whole lines, found by column; None, and ``at`` as it was, where lines aren't plain.

    Plain lines are not empty, end with a line feed alone, have numbers of digits,
    and keep all rules; whatever doesn't is for ``words_of`` to read or to refuse.
    """
    head = "\t".join(NAMES).encode() + b"\n"
    if at.number < 0:
        if not block.startswith(head):
            return None
        block = block[len(head) :]
    block = block if block.endswith(b"\n") else block + b"\n"
    signs = np.frombuffer(block, np.uint8)
    ends, tabs = np.flatnonzero(signs == ord("\n")), np.flatnonzero(signs == ord("\t"))
    n, before = len(ends), max(at.number, 0)
    if b"\r" in block or len(tabs) != (len(NAMES) - 1) * n or before + n > most_rows:
        return None
    begins, texts = np.concatenate([[0], ends[:-1] + 1]), tabs[len(NAMES) - 2 :: len(NAMES) - 1]
    strange = np.concatenate([[0], np.cumsum(~_PLAIN[signs], dtype=np.int32)])  # before each place
    if (strange[texts] != strange[begins]).any() or max((texts - begins).max(), (ends - texts).max()) > most_chars:
        return None
    try:
        table = csv.read_csv(
            pa.BufferReader(block),
            csv.ReadOptions(use_threads=False, block_size=len(block) + 1, column_names=NAMES),
            csv.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=False),
            csv.ConvertOptions(column_types=_TYPES, null_values=[], strings_can_be_null=False),
        ).combine_chunks()
    except pa.ArrowInvalid:
        return None
    level, conf, place = table["level"].to_numpy(), table["conf"].to_numpy(), np.stack([table[n].to_numpy() for n in NAMES[PLACE]])
    word = level == WORD_LEVEL
    right = np.where(word, (place[0] >= 1) & (place[4] >= 1) & (place.min(0) >= 0) & (conf >= -1) & (conf <= 100), conf == -1)
    text = pc.utf8_trim_whitespace(table["text"])
    kept = np.flatnonzero(word & (conf >= 0) & (pc.binary_length(text).to_numpy() > 0))
    place = np.concatenate([np.array([at.last] if at.last else [], np.int64).reshape(-1, 5).T, place[:, kept]], axis=1)
    later, same = np.zeros(max(place.shape[1] - 1, 0), bool), True
    for p in place:
        later |= same & (p[1:] > p[:-1])
        same &= p[1:] == p[:-1]
    if table.num_rows != n or not right.all() or not later.all():
        return None
    at.number, at.last = before + n, tuple(place[:, -1].tolist()) if place.shape[1] else None
    columns = [*(table[c] for c in NAMES[1:11]), text]
    if len(kept) < n:
        columns = [c.take(pa.array(kept)) for c in columns]
    columns = [c.combine_chunks() for c in columns]
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(kept)), pa.array(kept + (before + 1)), *columns], schema=ARROW)


def _blocks(raw: io.IOBase) -> Iterator[bytes]:
    """A file in blocks of whole lines; at least one."""
    held: list[bytes] = []
    while piece := raw.read(BLOCK):
        if cut := piece.rfind(b"\n") + 1:
            yield b"".join([*held, piece[:cut]])
            held, piece = [], piece[cut:]
        held.append(piece)
    if any(held) or not held:
        yield b"".join(held)


@dataclass
class Files(InputPartition):
    """Whole files that one task reads, one after the other."""

    paths: list[str]


class WordTableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.most_rows, self.most_chars = int(options.get("most_rows", 100_000)), int(options.get("most_chars", 10_000))
        self.task_bytes = int(options.get("task_bytes", 64 << 20))

    def partitions(self) -> list[Files]:
        """Files in order of their paths, in parts of ``task_bytes`` or of one file."""
        system, root = fs.FileSystem.from_uri(self.uri)
        top = system.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        infos = [top] if top.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        parts, held = [], 0
        for i in sorted((i for i in infos if i.is_file and i.base_name[0] not in "._"), key=lambda i: i.path):
            if not parts or held + i.size > self.task_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(i.path)
            held += i.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        limits = self.most_rows, self.most_chars
        for path in partition.paths:
            at = _At()
            with system.open_input_stream(path) as raw:
                for block in _blocks(raw):
                    if (words := plain_words(block, path, *limits, at)) is not None:
                        yield from (words.slice(lo, BATCH) for lo in range(0, words.num_rows, BATCH))
                        continue
                    lines = io.TextIOWrapper(io.BytesIO(block), "utf-8", newline="")
                    for rows in batched(words_of(lines, path, *limits, at), BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class WordTables(DataSource):
    """``spark.read.format("word_table").load(folder)``; options ``most_rows`` and ``most_chars`` (of a file and a field), ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "word_table"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WordTableReader:
        return WordTableReader(dict(self.options))


def read_word_tables(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(file, row_no, page_num, ... text) of all word tables in a folder, or of one file; each is checked in the task that reads it.

    Names that begin with a dot or an underscore are no tables. A table that breaks
    its form fails the job with ``Malformed``.
    """
    spark.dataSource.register(WordTables)
    return spark.read.format("word_table").options(**options).load(path)
