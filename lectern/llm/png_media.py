"""Media columns: payloads as PNG images in a binary column, and cosine-transform hashes of them.

``encode_png`` writes one greyscale image of 8-bit samples, 64 wide, for each
payload; ``read_png`` parses the chunks again, tests every checksum, undoes the
row filters with numpy and gives the payload with a perceptual hash of 64 bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textkit import chunks, utf8

WIDTH = 64
#: Bytes of payloads in one batch, unless one payload is longer.
BATCH_BYTES = 32_000_000
#: The eight bytes that open each PNG file (fixed by the format).
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes, level: int = 1) -> bytes:
    """A greyscale image of 8-bit samples; the payload's length is a positive multiple of 64.

    All rows use one filter: none, left or up, whichever leaves the smallest differences.
    """
    img = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, up = img.copy(), img.copy()
    left[:, 1:] -= img[:, :-1]
    up[1:] -= img[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (img, left, up)]
    kind = int(np.argmin(cost))
    rows = np.empty((len(img), WIDTH + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, (img, left, up)[kind]
    head = struct.pack(">IIBBBBB", WIDTH, len(img), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts, cuts[1:]):
        above = data[a - 1] if a else np.zeros(data.shape[1], np.uint8)
        if kinds[a] == 1:
            np.cumsum(data[a:b], axis=1, dtype=np.uint8, out=data[a:b])
        elif kinds[a] == 2:
            data[a] += above
            np.cumsum(data[a:b], axis=0, dtype=np.uint8, out=data[a:b])
        elif kinds[a] in (3, 4):  # each sample needs the one before it
            for r in range(a, b):
                prev = (data[r - 1] if r else np.zeros(data.shape[1], np.uint8)).astype(int)
                line = data[r].astype(int)
                for i in range(len(line)):
                    w, n, nw = (line[i - 1] if i else 0), prev[i], (prev[i - 1] if i else 0)
                    if kinds[a] == 3:
                        guess = (w + n) // 2
                    else:
                        p = w + n - nw
                        guess = min((w, n, nw), key=lambda x: abs(p - x))
                    line[i] = (line[i] + guess) & 255
                data[r] = line
        elif kinds[a] > 4:
            raise ValueError(f"unknown row filter {kinds[a]}")
    return data


def image_of(png: bytes) -> np.ndarray:
    """The samples of a greyscale 8-bit image; a wrong checksum or form is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, width, height, body, ended = 8, None, None, [], False
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only greyscale, 8 bits, not interlaced")
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if not ended:
        raise ValueError("the image is cut off")
    raw = zlib.decompress(b"".join(body))
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


_SIDE = 32
_COS = np.cos(np.pi / _SIDE * (np.arange(_SIDE)[None, :] + 0.5) * np.arange(8)[:, None])


def cosine_hash(img: np.ndarray) -> str:
    """64 bits in hex: the 8 x 8 lowest cosine coefficients of a 32 x 32 reduction, over their median."""
    small = img.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        if n >= _SIDE:
            cuts = np.arange(_SIDE) * n // _SIDE
            sizes = np.diff(np.append(cuts, n))
            small = np.add.reduceat(small, cuts, axis=axis) / (sizes[:, None] if axis == 0 else sizes[None, :])
        else:
            small = np.take(small, np.arange(_SIDE) * n // _SIDE, axis=axis)
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def encode_png(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """(id, n_bytes, png): each text as UTF-8, filled with bytes 0 to a positive multiple of 64.

    A null text counts as empty and gives an image of one black row. Rows are
    handled one by one, so repeated rows, null ids and empty tables need no
    special case; columns beyond the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(utf8(b.column(1))[1], BATCH_BYTES, 512):
                part = b.slice(lo, hi - lo)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                png = [png_of(x + b"\0" * (-len(x) % WIDTH if x else WIDTH), level) for x in raw]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(png, pa.binary())], ["doc_id", "n_bytes", "png"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, png binary")


def read_png(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media_bytes, media_sha256, feature) of images that ``encode_png`` stored.

    A null image gives nulls; a damaged one is an error that names the chunk.
    """
    schema = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [WIDTH * int.from_bytes(x[20:24], "big") if x else 0 for x in (v.as_py() for v in b.column(2))]
            for lo, hi in chunks(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), BATCH_BYTES, 512):
                part = b.slice(lo, hi - lo)
                rows = []
                for png in part.column(2).to_pylist():
                    if png is None:
                        rows.append((None,) * 4)
                        continue
                    img = image_of(png)
                    rows.append((img.tobytes(), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(img)))
                cols = list(zip(*rows)) if rows else [()] * 4
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "png").mapInArrow(run, schema)


def op9_png_media(spark, sf_dir: str) -> DataFrame:
    """Every text of documents through its image and back, with digests of what was read."""
    back = read_png(encode_png(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    payload = F.col("payload")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
