"""Substring deduplication with a compressed FM-index for each shard.

A window is ``LENGTH`` consecutive words of one document. Its minimizer, the
smallest hash of the runs of ``SEED`` words in it, is the same wherever the window
stands. Three exchanges of compact messages do the work:

1. Shards of documents send the minimizers they hold, with counts, to ranges of
   hash values; the answer says which are unique, repeated or very frequent.
2. Stretches of windows with one repeated minimizer (windows of a very frequent
   one singly, dealt by the whole window) go to index shards; equal stretches of
   a document shard go once. An index shard sorts its text by the first
   LENGTH words, keeps the Burrows-Wheeler transform in a wavelet matrix, and
   streams every stretch through it by backward search. The matching statistic
   of a place is at least LENGTH by construction; its interval holds all equal
   windows, and the smallest (document, start) among them decides.
3. The verdicts return to the document shards, which drop the covered words.

No window is listed in pairs, and no message grows with a passage's frequency
beyond one copy for each document shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.exchange import MESSAGE, by_destination, messages, pack, slices, unpack
from lectern.llm.shared import stored
from lectern.llm.textkit import chunks, mix, powers, ragged, span_hashes, utf8, word_spans

LENGTH, SEED = 20, 8
#: Words in a document shard and in an index shard, and the count from which a minimizer is very frequent.
SHARD_WORDS, INDEX_WORDS, FREQUENT = 1_000_000, 1_500_000, 20_000
BODY, CODES, STRETCHES, VERDICTS = 0, 1, 2, 3
#: Bytes of text in one batch of results, unless one text is longer.
BATCH_BYTES = 64_000_000


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place (places near the end: of no use)."""
    k = len(words)
    with np.errstate(over="ignore"):
        up, down = powers(k + 1)
        sums = np.zeros(k + n + 1, np.uint64)
        np.cumsum(words * up[:k], out=sums[1 : k + 1])
        sums[k + 1 :] = sums[k]
        return mix((sums[n : n + k] - sums[:k]) * down[:k])


class Shard:
    """Whole documents as words joined by one space, with what their windows need."""

    def __init__(self, doc_ids, known, counts, text: bytes):
        self.doc_ids, self.known, self.counts, self.text = doc_ids, known, counts, text
        self.buf = np.frombuffer(text, np.uint8)
        self.ends = np.flatnonzero(self.buf == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def hash_words(self) -> np.ndarray:
        parts = []
        for lo in range(0, len(self.starts), 200_000):
            s, e = self.starts[lo : lo + 200_000], self.ends[lo : lo + 200_000]
            parts.append(span_hashes(self.buf[s[0] : e[-1]], s - s[0], e - s[0], lower=False))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes; places of all windows; their minimizers and where these stand."""
        words = self.hash_words()
        n = len(words)
        room = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(room >= LENGTH)
        low, place = run_hashes(words, SEED), np.arange(n)
        width, span = 1, LENGTH - SEED + 1
        while width < span:
            step = min(width, span - width)
            later, where = low[step:], place[step:]
            better = later < low[: n - step]
            low[: n - step] = np.where(better, later, low[: n - step])
            place[: n - step] = np.where(better, where, place[: n - step])
            width += step
        return words, at, low[at], place[at]

    def seeds(self):
        """Sorted distinct minimizers, their number of places, and the index of each window's one."""
        words, at, low, place = self.windows()
        values, inverse = np.unique(low, return_inverse=True)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (low[1:] != low[:-1])
        return values, np.bincount(inverse[new], minlength=len(values)), inverse, words, at, low, place

    def stretches(self, codes: np.ndarray, n_index: int, found=None) -> dict[str, np.ndarray]:
        """Runs of windows that the index must see: start word, windows, index shard, and the leader of equal ones."""
        _, _, inverse, words, at, low, place = found or self.seeds()
        code = codes[inverse]
        keep = np.flatnonzero(code > 0)
        at, code, low, place = at[keep], code[keep], low[keep], place[keep]
        new = np.ones(len(at), bool)
        new[1:] = (code[1:] == 2) | (code[:-1] == 2) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        start = at[begin]
        with np.errstate(over="ignore"):
            up, down = powers(len(words) + 1)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * up[: len(words)], out=sums[1:])
            content = mix((sums[start + size + LENGTH - 1] - sums[start]) * down[start]) ^ mix(size.astype(np.uint64))
            route = np.where(code[begin] == 2, content, mix(low[begin]))
        doc = np.searchsorted(self.first, start, side="right") - 1
        key, known, inner = self.doc_ids[doc], self.known[doc], start - self.first[doc]
        order = np.lexsort((inner, key, known, content))
        lead = np.ones(len(order), bool)
        c = content[order]
        lead[1:] = c[1:] != c[:-1]
        leader = np.empty(len(order), np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        later = (key != key[leader]) | (known != known[leader]) | (inner != inner[leader])
        index = ((route >> np.uint64(32)) * np.uint64(n_index) >> np.uint64(32)).astype(np.int64)
        return {"start": start, "size": size, "index": index, "leader": leader, "later": later, "key": key, "known": known, "inner": inner}


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Messages of kind BODY: whole documents in shards of about ``shard_words`` words; src counts the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, number, part = [], 0, 0, TaskContext.get().partitionId()

        def flush():
            nonlocal held, words, number
            ids, known, counts, texts = zip(*held)
            body = pack(np.concatenate(ids), np.concatenate(known), np.concatenate(counts), b"".join(texts))
            row = messages([((part << 32) + number, BODY, words, body)])
            held, words, number = [], 0, number + 1
            return row

        for b in batches:
            buf, off = utf8(b.column(1))
            known = np.asarray(b.column(0).is_valid())
            ids = np.asarray(b.column(0).fill_null(0))
            for lo, hi in chunks(off):
                starts, ends, first = word_spans(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                size = ends - starts + 1
                flat = np.append(buf[off[lo] : off[hi]], np.uint8(32))[ragged(starts, size)] if len(starts) else np.zeros(0, np.uint8)
                if len(starts):
                    flat[np.cumsum(size) - 1] = 32
                held.append((ids[lo:hi], known[lo:hi], np.diff(first), flat.tobytes()))
                words += len(starts)
                if words >= shard_words:
                    yield flush()
        if held:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, MESSAGE)


class WaveletMatrix:
    """Bits of a sequence by level, each with counts of ones before every 64th place."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        n = len(seq)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, bool)
            padded[:n] = bit
            w = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(w)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w))[:-1]]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self.follow(np.arange(sigma), np.zeros(sigma, np.int64))

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][block] + np.bitwise_count(self.words[k][block] & mask)
            i = np.where(symbol >> (self.levels - 1 - k) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.follow(symbol, i) - self.base[symbol]


class FMIndex:
    """Of a text of symbols, sorted by the first LENGTH symbols; 0 is the separator."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)

        def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
            """Ranks of a longer prefix from those of its two parts."""
            second = np.zeros(n, np.int64)
            second[: n - shift] = b[shift:] + 1
            return np.unique(a * (int(b.max()) + 2) + second, return_inverse=True)[1]

        ranks, width = {1: text.astype(np.int64)}, 1
        while 2 * width <= LENGTH:
            ranks[2 * width] = joined(ranks[width], ranks[width], width)
            width *= 2

        def of(length: int) -> np.ndarray:
            rest = next(w for w in sorted(ranks) if w >= length - width) if length > width else None
            return ranks[width] if rest is None else joined(ranks[width], ranks[rest], length - rest)

        full, short = of(LENGTH), of(LENGTH - 1)
        self.order = np.argsort(full, kind="stable")
        self.group = full[self.order]  # equal windows are neighbours
        inside = short[self.order]
        cut = np.flatnonzero(np.diff(inside)) + 1
        self.short_low = np.repeat(np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [n]])))
        self.short_high = np.repeat(np.concatenate([cut, [n]]), np.diff(np.concatenate([[0], cut, [n]])))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(text[self.order - 1], sigma)
        self.n = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the pattern with one symbol put before it."""
        base = self.before[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the pattern of LENGTH symbols without its last one."""
        return self.short_low[low], self.short_high[low]

    def matching(self, text: np.ndarray, end: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Backward search of many stretches at once, from their ends.

        Yields (steps done, which stretches, low, high) whenever the matched
        length has reached LENGTH.
        """
        which = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        for t in range(1, int(steps.max(initial=0)) + 1):
            go = steps[which] >= t
            which, low, high = which[go], low[go], high[go]
            if t > LENGTH:
                low, high = self.shorten(low)
            low, high = self.step(text[end[which] - t], low, high)
            if t >= LENGTH:
                yield t, which, low, high


def judge(stretches: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Builds the index over what an index shard got and answers each sender: which windows stand earlier too."""
    parts = [(src, *unpack(p)) for src, p in stretches]
    sizes = np.concatenate([p[1] for p in parts])
    key, known, inner = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    texts = [np.frombuffer(p[5], np.uint8) for p in parts]
    hashes = []
    for buf in texts:
        ends = np.flatnonzero(buf == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        for lo in range(0, len(starts), 200_000):
            s, e = starts[lo : lo + 200_000], ends[lo : lo + 200_000]
            hashes.append(span_hashes(buf[s[0] : e[-1]], s - s[0], e - s[0], lower=False))
    distinct, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
    words = sizes + LENGTH - 1
    first = np.concatenate([[0], np.cumsum(words + 1)])[:-1]  # each stretch is followed by a separator
    text = np.zeros(int((words + 1).sum()), np.int64)
    text[ragged(first, words)] = symbol + 1
    index = FMIndex(text, len(distinct) + 1)
    # the smallest (document, start) of each group of equal windows; other places count as last
    place = ragged(first, sizes)
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    start = inner[stretch] + place - first[stretch]
    order = np.lexsort((start, key[stretch], known[stretch]))
    turn = np.empty(len(order), np.int64)
    new = np.ones(len(order), bool)
    o = order
    new[1:] = (start[o[1:]] != start[o[:-1]]) | (key[stretch[o[1:]]] != key[stretch[o[:-1]]]) | (known[stretch[o[1:]]] != known[stretch[o[:-1]]])
    turn[order] = np.cumsum(new)
    at_place = np.full(len(text), np.iinfo(np.int64).max)
    at_place[place] = turn
    edges = np.concatenate([[0], np.flatnonzero(np.diff(index.group)) + 1])
    lowest = np.minimum.reduceat(at_place[index.order], edges)[index.group]
    earlier = np.zeros(len(place), bool)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    for t, which, low, high in index.matching(text, first + words, words):
        window = words[which] - t  # the stretch's window that the match begins with
        if not (high > low).all():
            raise RuntimeError("a stretch is not in its own index")
        earlier[offset[which] + window] = lowest[low] < turn[offset[which] + window]
    out, s = [], 0
    for p in parts:
        n = len(p[1])
        out.append((p[0], pack(np.packbits(earlier[offset[s] : offset[s + n]]))))
        s += n
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, index_words: int = INDEX_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): each document without the words of windows that also start earlier.

    Earlier: in a document with a smaller id, or in the same one at an earlier
    word. ``removed`` lists the ranges of words that went, ``kept`` is the rest
    joined by one space. A null text has no words; null ids come before all
    others. Rows that repeat an id aren't earlier than each other at the same
    start. Other columns are ignored; an empty table gives no rows.
    """
    bodies = stored(shards(docs, id_col, text_col, shard_words), "shards")
    words = bodies.agg(F.sum("src")).first()[0] or 0
    n_ranges = max(8, -(-words // 4_000_000))
    n_index = max(8, -(-words // index_words))

    def send_seeds(batches):
        for b in batches:
            for dest, payload in zip(b.column(0).to_pylist(), b.column(3)):
                values, counts, *_ = Shard(*unpack(payload.as_py())).seeds()
                cuts = slices(values, n_ranges)
                yield messages([(r, BODY, dest, pack(values[a:z], counts[a:z].astype(np.uint32))) for r, (a, z) in enumerate(zip(cuts[:-1], cuts[1:]))])

    def merge_seeds(dest, rows):
        parts = [(src, *unpack(p)) for _, src, p in rows]
        values = np.concatenate([p[1] for p in parts])
        distinct, inverse = np.unique(values, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([p[2] for p in parts]), minlength=len(distinct))
        code = np.where(total > frequent, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[inverse]
        cuts = np.cumsum([0] + [len(p[1]) for p in parts])
        yield messages([(p[0], CODES, dest, pack(code[a:z])) for p, a, z in zip(parts, cuts[:-1], cuts[1:])])

    def codes_of(rows):
        parts = [unpack(p)[0] for kind, _, p in rows if kind == CODES]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def send_stretches(dest, rows):
        shard = Shard(*unpack(rows[0][2]))
        s = shard.stretches(codes_of(rows), n_index)
        lead = np.flatnonzero(s["leader"] == np.arange(len(s["leader"])))
        lead = lead[np.argsort(s["index"][lead], kind="stable")]
        cuts = np.searchsorted(s["index"][lead], np.arange(n_index + 1))
        out = []
        for r, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if z > a:
                mine = lead[a:z]
                begin = shard.starts[s["start"][mine]]
                size = shard.ends[s["start"][mine] + s["size"][mine] + LENGTH - 2] + 1 - begin
                out.append((r, STRETCHES, dest, pack(s["size"][mine], s["key"][mine], s["known"][mine], s["inner"][mine], shard.buf[ragged(begin, size)].tobytes())))
        if out:
            yield messages(out)

    def answer(dest, rows):
        yield messages([(src, VERDICTS, dest, payload) for src, payload in judge([(src, p) for _, src, p in rows])])

    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"

    def finish(dest, rows):
        shard = Shard(*unpack(rows[0][2]))
        s = shard.stretches(codes_of(rows), n_index)
        lead = np.flatnonzero(s["leader"] == np.arange(len(s["leader"])))
        lead = lead[np.argsort(s["index"][lead], kind="stable")]
        gone = np.zeros(len(shard.starts) + 1, np.int64)
        if len(lead):
            size = s["size"][lead]
            bits, at = [], 0
            cuts = dict(zip(*np.unique(s["index"][lead], return_counts=True)))
            for kind, src, p in rows:
                if kind == VERDICTS:
                    n = int(size[at : at + cuts[src]].sum())
                    bits.append(np.unpackbits(unpack(p)[0], count=n).astype(bool))
                    at += cuts[src]
            verdict = np.concatenate(bits)
            offset = np.zeros(len(s["leader"]), np.int64)
            offset[lead] = np.cumsum(size) - size
            each = np.repeat(np.arange(len(s["leader"])), s["size"])
            inner = np.arange(len(each)) - np.repeat(np.cumsum(s["size"]) - s["size"], s["size"])
            removed = verdict[offset[s["leader"]][each] + inner] | s["later"][each]
            start = (s["start"][each] + inner)[removed]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + LENGTH, -1)
        gone = np.cumsum(gone[:-1]) > 0
        for lo, hi in chunks(np.concatenate([[0], shard.ends + 1])[shard.first], BATCH_BYTES, 2_000):
            cols = [[], [], []]
            for d in range(lo, hi):
                a, z = shard.first[d], shard.first[d + 1]
                g = gone[a:z]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
                cols[0].append(int(g.sum()))
                cols[1].append([{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])])
                stay = np.flatnonzero(~g) + a
                if len(stay) == z - a:
                    text = shard.text[shard.starts[a] : shard.ends[z - 1]] if z > a else b""
                elif len(stay):
                    text = shard.buf[ragged(shard.starts[stay], shard.ends[stay] + 1 - shard.starts[stay])].tobytes()[:-1]
                else:
                    text = b""
                cols[2].append(text.decode())
            yield pa.record_batch(
                [
                    pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=~shard.known[lo:hi]),
                    pa.array(shard.counts[lo:hi], pa.int64()),
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(cols[2], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    seeds = bodies.mapInArrow(send_seeds, MESSAGE)
    codes = stored(by_destination(seeds, merge_seeds, MESSAGE), "codes")
    stretches = by_destination(bodies.unionByName(codes), send_stretches, MESSAGE)
    verdicts = by_destination(stretches, answer, MESSAGE)
    return by_destination(bodies.unionByName(codes).unionByName(verdicts), finish, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of 20 words, as digests."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM words WHERE len(w) >= 20)
), firsts AS (
  SELECT s, min({'d': doc_id, 'k': k}) AS first FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS place
  FROM windows JOIN firsts USING (s) WHERE {'d': doc_id, 'k': k} <> first
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words
)
SELECT d.doc_id, count(p.word) AS n_words, count(g.place) AS n_removed,
  sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.place) FILTER (g.place IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id
LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place GROUP BY d.doc_id
"""
