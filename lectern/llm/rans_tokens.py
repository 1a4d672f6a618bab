"""Token ids in compressed binary segments: a static range asymmetric numeral system.

A segment is one self-contained file body of some two million tokens of whole
documents. It holds one frequency table, shared by its blocks; a document
directory; and independent blocks, each coded by ``LANES`` interleaved coders.
The block directory keeps the checkpoints (first token, first word, coder
states, checksum), so any block can be decoded alone and all of them at once.

Layout, little-endian: magic, sizes, and a CRC-32 of the header; zlib-packed
table; zlib-packed document directory; block directory; 32-bit code words.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.presplit import PieceEncoder, blank, byte_letters, split_spaced
from lectern.llm.shared import shared_folder
from lectern.llm.textkit import ragged

MAGIC = b"RANSEG01"
SCALE = 18  # frequencies sum to 2**SCALE
LANES = 32
BLOCK = 32_768  # tokens
LOW = np.uint64(1 << 31)
PIECES_A_CALL = 500
_HEAD = struct.Struct("<8sQIIIII")


def shared_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 where a count is."""
    total, room = int(counts.sum()), 1 << SCALE
    present = np.flatnonzero(counts)
    if len(present) > room:
        raise ValueError("more symbols than the table has room for")
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    freq[present] = 1 + (counts[present] * (room - len(present))) // total
    freq[present[np.argmax(counts[present])]] += room - int(freq.sum())
    return freq


def _rans_encode(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes a (steps, coders) array; gives states, words by coder and their number."""
    steps, width = symbols.shape
    x = np.full(width, LOW, np.uint64)
    out = np.zeros((width, steps), np.uint32)
    used = np.zeros((width, steps), bool)
    f, c = freq.astype(np.uint64), cum.astype(np.uint64)
    top = (LOW >> np.uint64(SCALE)) << np.uint64(32)
    for t in range(steps - 1, -1, -1):
        ft = f[symbols[t]]
        full = x >= top * ft
        out[full, t] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        used[:, t] = full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // ft
        x = (q << np.uint64(SCALE)) + (x - q * ft) + c[symbols[t]]
    return x, out[used], used.sum(1)


def _rans_decode(x: np.ndarray, words: np.ndarray, first: np.ndarray, steps: int, slot: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    x, at = x.copy(), first.copy()
    out = np.empty((steps, len(x)), np.int32)
    f, c = freq.astype(np.uint64), cum.astype(np.uint64)
    mask = np.uint64((1 << SCALE) - 1)
    words = np.append(words, np.zeros(1, np.uint32)).astype(np.uint64)
    for t in range(steps):
        low = x & mask
        s = slot[low]
        out[t] = s
        x = f[s] * (x >> np.uint64(SCALE)) + low - c[s]
        need = x < LOW
        x = np.where(need, (x << np.uint64(32)) | words[np.minimum(at, len(words) - 1)], x)
        at += need
    if not (x == LOW).all():
        raise ValueError("a coder did not end in its first state")
    return out


def pack_segment(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: documents in order, with their ids one after another."""
    counts = np.bincount(ids, minlength=1)
    freq = shared_table(counts)
    present = np.flatnonzero(freq)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    table = zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + freq[present].astype("<u4").tobytes(), 6)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + known.astype("u1").tobytes() + lengths.astype("<u8").tobytes(), 1)
    n_blocks = -(-len(ids) // BLOCK)
    directory, body, words_before = [], [], 0
    whole = len(ids) // BLOCK
    for lo, hi in ((0, whole), (whole, n_blocks)):
        if lo == hi:
            continue
        part = ids[lo * BLOCK : hi * BLOCK]
        size = BLOCK if lo == 0 and whole else len(part)
        steps = -(-size // LANES)
        padded = np.full((hi - lo) * steps * LANES, present[0], np.int64)
        padded[: len(part)] = part
        grid = padded.reshape(hi - lo, steps, LANES).transpose(1, 0, 2).reshape(steps, -1)
        states, words, per_coder = _rans_encode(grid, freq, cum)
        per_block = per_coder.reshape(-1, LANES).sum(1)
        cuts = np.concatenate([[0], np.cumsum(per_block)])
        for b in range(hi - lo):
            code = words[cuts[b] : cuts[b + 1]].astype("<u4").tobytes()
            lanes = states[b * LANES : (b + 1) * LANES].astype("<u8").tobytes() + per_coder[b * LANES : (b + 1) * LANES].astype("<u4").tobytes()
            tokens = size if lo == 0 and whole else len(part)
            directory.append(struct.pack("<QQII", (lo + b) * BLOCK, words_before + int(cuts[b]), tokens, zlib.crc32(lanes + code)) + lanes)
            body.append(code)
        words_before += int(cuts[-1])
    blocks = b"".join(directory)
    head = _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(table), len(docs), n_blocks, zlib.crc32(table + docs + blocks))
    return head + struct.pack("<I", zlib.crc32(head)) + table + docs + blocks + b"".join(body)


_ENTRY = struct.calcsize("<QQII") + LANES * 12


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four arrays that ``pack_segment`` got; a wrong checksum is an error."""
    magic, n_ids, n_docs, n_table, n_dir, n_blocks, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or struct.unpack_from("<I", data, _HEAD.size)[0] != zlib.crc32(data[: _HEAD.size]):
        raise ValueError("no segment, or its header is damaged")
    at = _HEAD.size + 4
    end = at + n_table + n_dir + n_blocks * _ENTRY
    if zlib.crc32(data[at:end]) != crc:
        raise ValueError("table or directories are damaged")
    table = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4")
    docs = zlib.decompress(data[at + n_table : at + n_table + n_dir])
    doc_ids, known = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "u1", n_docs, 8 * n_docs).astype(bool)
    lengths = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    present = np.cumsum(table[: len(table) // 2].astype(np.int64))
    freq = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    freq[present] = table[len(table) // 2 :]
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    ids = np.empty(n_ids, np.int32)
    entries = []
    for b in range(n_blocks):
        e = at + n_table + n_dir + b * _ENTRY
        start, word, tokens, check = struct.unpack_from("<QQII", data, e)
        states = np.frombuffer(data, "<u8", LANES, e + 24)
        per = np.frombuffer(data, "<u4", LANES, e + 24 + 8 * LANES)
        code = data[end + 4 * word : end + 4 * (word + int(per.sum()))]
        if zlib.crc32(data[e + 24 : e + _ENTRY] + code) != check:
            raise ValueError(f"block {b} is damaged")
        entries.append((tokens, start, states, per, word))
    words = np.frombuffer(data, "<u4", (len(data) - end) // 4, end)
    for size in sorted({e[0] for e in entries}):
        mine = [e for e in entries if e[0] == size]
        steps = -(-size // LANES)
        per = np.concatenate([e[3] for e in mine]).astype(np.int64)
        first = np.concatenate([e[4] + np.concatenate([[0], np.cumsum(e[3].astype(np.int64))[:-1]]) for e in mine]).astype(np.int64)
        grid = _rans_decode(np.concatenate([e[2] for e in mine]).astype(np.uint64), words, first, steps, slot, freq, cum)
        by_block = grid.reshape(steps, len(mine), LANES).transpose(1, 0, 2).reshape(len(mine), -1)
        for row, e in zip(by_block, mine):
            ids[e[1] : e[1] + size] = row[:size]
    return doc_ids, known, lengths, ids


class ByteTokenizer:
    """The tokenizers library with a cache of pieces in front of it; made once a process."""

    _made: dict[str, "ByteTokenizer"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        control = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters, vocab = byte_letters(), self.library.get_vocab()
        self.opens, self.breaks = np.zeros((2, max(vocab.values()) + 1), bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(letters[32])]] = True
        self.breaks[vocab[letters[10]]] = True
        self.encoder = PieceEncoder(split_spaced, False, self._new, self._slow, control)

    @classmethod
    def of(cls, path: str) -> "ByteTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _new(self, signs: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: many pieces are given to the library as one text that it splits into just these again.

        Pieces that begin with a plain space stand side by side; those that begin
        with a visible sign have line breaks between them; runs of white space go
        one by one. The tokens with a space in front, or the breaks, tell where a
        piece begins.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        size, first = np.diff(off), signs[off[:-1]]
        second = signs[np.minimum(off[:-1] + 1, len(signs) - 1)]
        led = (first == 32) & (size > 1) & ~blank(second)
        bare = ~blank(first)
        n = np.zeros(len(size), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # pieces and their ids, one after another
        for which, marks, between in ((led, self.opens, 0), (bare, self.breaks, 1)):
            at = np.flatnonzero(which)
            for lo in range(0, len(at), PIECES_A_CALL):
                part = at[lo : lo + PIECES_A_CALL]
                width = size[part] + between
                flat = np.full(int(width.sum()), 10, np.uint32)
                flat[ragged(np.cumsum(width) - width + between, size[part])] = signs[ragged(off[:-1][part], size[part])]
                ids = np.array(self.library.encode(flat.tobytes().decode("utf-32-le"), add_special_tokens=False).ids, np.int32)
                begin = np.flatnonzero(marks[ids])
                if len(begin) != len(part):
                    raise RuntimeError("the library split a block of pieces in another way")
                n[part] = np.diff(np.append(begin, len(ids))) - between
                found.append((part, np.delete(ids, begin) if between else ids))
        rest = np.flatnonzero(~led & ~bare)
        if len(rest):
            alone = [np.array(e.ids, np.int32) for e in self.library.encode_batch([signs[off[i] : off[i + 1]].tobytes().decode("utf-32-le") for i in rest], add_special_tokens=False)]
            n[rest] = [len(x) for x in alone]
            found.append((rest, np.concatenate(alone)))
        out, begin = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
        for part, ids in found:
            out[ragged(begin[part], n[part])] = ids
        return out, n

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


SEGMENT_SCHEMA = "part int, segment int, n_docs long, n_tokens long, body binary"


def write_segments(df: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 2_000_000) -> DataFrame:
    """Writes each whole text's ids and the end id, in ascending id order, and returns the written rows.

    Rows are range-partitioned and sorted by id (nulls first; repeated ids stay,
    in no fixed order among themselves); part and segment number the order.
    Null and empty texts hold the end id only. A segment ends after the document
    that fills it, so a very long text makes a longer segment. An empty table
    writes no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, number = ByteTokenizer.of(path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal held, tokens, number
            doc_ids, known, lengths, ids = (np.concatenate(x) for x in zip(*held))
            body = pack_segment(doc_ids, known, lengths, ids)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())]
            held, tokens, number = [], 0, number + 1
            return pa.record_batch(row, ["part", "segment", "n_docs", "n_tokens", "body"])

        for b in batches:
            keys = b.column(0)
            known = np.asarray(keys.is_valid())
            values = np.asarray(keys.fill_null(0))
            for lo, ids, off in tokenizer.encoder.encode_column(b.column(1)):
                n = len(off) - 1
                held.append((values[lo : lo + n], known[lo : lo + n], np.diff(off) + 1, np.insert(ids, off[1:], end_id)))
                tokens += len(ids) + n
                if tokens >= segment_tokens:
                    yield flush()
        if held:
            yield flush()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "uncompressed").mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(SEGMENT_SCHEMA).parquet(folder)


def read_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the segments; start counts the ids before.

    The offsets come from the token counts beside the bodies: within a part by a
    window over its few segments, over the parts by a window over one row each.
    Rows of one id stay apart, each with a start of its own; a segment that is
    damaged is an error; no segment gives no rows.
    """
    sizes = segments.select("part", "segment", "n_tokens")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    places = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner_start")).join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("inner_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                doc_ids, known, lengths, ids = unpack_segment(body)
                off = np.concatenate([[0], np.cumsum(lengths)])
                step = 500
                for lo in range(0, len(doc_ids), step):
                    hi = min(lo + step, len(doc_ids))
                    flat = ids[off[lo] : off[hi]]
                    yield pa.record_batch(
                        [
                            pa.array([part] * (hi - lo), pa.int32()),
                            pa.array([segment] * (hi - lo), pa.int32()),
                            pa.array(doc_ids[lo:hi], pa.int64(), mask=~known[lo:hi]),
                            pa.array(off[lo:hi], pa.int64()),
                            pa.array(lengths[lo:hi], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(off[lo : hi + 1] - off[lo], pa.int32()), pa.array(flat, pa.int32())),
                            pa.array([zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)], pa.int64()),
                        ],
                        ["part", "segment", "doc_id", "at", "n_tokens", "ids", "ids_crc32"],
                    )

    docs = segments.select("part", "segment", "body").mapInArrow(run, "part int, segment int, doc_id long, at long, n_tokens long, ids array<int>, ids_crc32 long")
    joined = docs.join(places, ["part", "segment"])
    return joined.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids", "ids_crc32")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_rans_tokens(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents as ids in segments, and what is read back from them."""
    folder = f"{shared_folder(spark)}/token-segments-{uuid.uuid4().hex}"
    segments = write_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_path(), end_id=2)
    return read_segments(segments).select("doc_id", "start", "n_tokens", "ids_crc32")
