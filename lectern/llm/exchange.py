"""Messages between shards: binary payloads dealt by destination, handled a destination at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

MESSAGE = "dest long, kind int, src long, payload binary"
_NAMES = ["dest", "kind", "src", "payload"]


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed payload: the number of parts, then type, size and content of each.

    Of numbers all first bytes stand together, then all second ones, and so on,
    which compresses the bytes that hardly change.
    """
    out = [len(parts).to_bytes(2, "little")]
    for part in parts:
        if isinstance(part, bytes):
            kind, data = "bytes", part
        else:
            kind, width = part.dtype.str, part.dtype.itemsize
            data = np.ascontiguousarray(np.ascontiguousarray(part).view(np.uint8).reshape(-1, width).T).tobytes()
        out += [kind.encode().ljust(8), len(data).to_bytes(8, "little"), data]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(payload: bytes) -> list[np.ndarray | bytes]:
    """The parts again."""
    data, at, out = zstandard.ZstdDecompressor().decompress(payload), 2, []
    for _ in range(int.from_bytes(data[:2], "little")):
        kind, n = data[at : at + 8].decode().strip(), int.from_bytes(data[at + 8 : at + 16], "little")
        at += 16
        if kind == "bytes":
            out.append(data[at : at + n])
        else:
            width = np.dtype(kind).itemsize
            flat = np.frombuffer(data, np.uint8, n, at).reshape(width, -1)
            out.append(np.ascontiguousarray(flat.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n
    return out


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.large_binary())
    return pa.record_batch([pa.array(c, k).cast(pa.binary()) if k == pa.large_binary() else pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


def by_destination(df: DataFrame, handle: Callable[[int, list[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Runs ``handle(dest, [(kind, src, payload), ...])`` once for each destination.

    Rows are dealt and sorted by Spark, and one destination is held at a time;
    the sender bounds what one destination gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dest, held = None, []
        for b in batches:
            cols = [b.column(i) for i in range(4)]
            for i in range(b.num_rows):
                d = cols[0][i].as_py()
                if d != dest and held:
                    yield from handle(dest, held)
                    held = []
                dest = d
                held.append((cols[1][i].as_py(), cols[2][i].as_py(), cols[3][i].as_py()))
        if held:
            yield from handle(dest, held)

    dealt = df.repartition(partitions, "dest") if partitions else df.repartition("dest")
    return dealt.sortWithinPartitions("dest", "kind", "src").mapInArrow(run, schema)


def slices(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n equal ranges of 64-bit keys (sorted) that name their destinations."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64) if n > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(np.int64)
