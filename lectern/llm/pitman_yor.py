"""Scoring with a hierarchical Pitman-Yor language model of word triples.

Every context of two words has a restaurant; those that end in the same word
share a parent, the restaurant of that word; all of these share the restaurant
of single words, whose base is uniform over the known words and one unknown one.
A table of a restaurant is a customer of its parent.

A round of the Gibbs sampler takes all customers of a dish out of a restaurant
and seats them anew, for every dish of every restaurant (``seat``). With the
sizes of the tables summed out, the number of tables has a closed conditional
distribution (generalised Stirling numbers), so one draw moves all customers of
a dish, however many they are; no probability of the model needs a table's size.
Restaurants are seated side by side: a draw sees its own seating taken out of
its restaurant and its parent, and the others as the round before left them.

The corpus is kept as shards of tokens in a bucketed table. Only compact
messages travel:

* words, pairs and triples go once to ranges of hash values, which add up the
  training counts and answer each shard (a shard sends each once, however often
  it has it, so no hot key exists). 40 bits name a pair or triple in its range;
* each shard keeps the pairs and triples that occur twice or more in a compact
  table of its own; the others have one customer and one table for ever;
* in each round every shard seats what it holds. Random numbers come from hashes,
  so all holders of an n-gram seat it alike, and one of them, its owner, reports
  the tables to the ranges, which add them up, seat the words and answer.

The score of a token is its predictive probability averaged over the rounds
after ``burn_in``; ``perplexity`` follows from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.exchange import MESSAGE, by_destination, messages, pack, slices, unpack
from lectern.llm.shared import discard, shared_folder, stored, without_shuffles
from lectern.llm.textkit import chunks, mix, span_hashes, utf8, word_spans

END, BEGIN = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x0B0E0B0E0B0E0B0E)
SHARD_TOKENS, WORDS_A_RANGE, GRAMS_A_RANGE = 1_400_000, 500_000, 2_000_000
#: Kinds of messages; those from STATS on carry a number for the driver in ``src``.
STATE, WORDS, PAIRS, TRIPLES, SEATED, TABLES, STATS = 1, 2, 3, 4, 5, 6, 100
STRENGTH = 1.0
#: Numbers of tables that are all weighed; a dish of more has a normal distribution around its mode.
WIDE = 128


# ---- seating


@lru_cache(maxsize=8)
def _ratios(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the rows, and S(c, t + 1) / S(c, t) of the generalised Stirling numbers for t = 1, 2, ...

    Exact up to 4,096 customers, rows for each up to 1,024 and then sixteen a
    doubling; beyond, the recurrence goes in small steps of the logarithm.
    """
    width, rows, at, t = 2_048, [], [], np.arange(1, 2_049)
    r = np.zeros(width)
    grid = iter([*range(1, 1_025), *(int(1_024 * 2 ** (k / 16)) for k in range(1, 481))])
    want, c = next(grid), 1
    with np.errstate(divide="ignore", invalid="ignore"):
        while True:
            if c == want:
                rows.append(r.astype(np.float32))
                at.append(c)
                want = next(grid, None)
                if want is None:
                    return np.array(at), np.array(rows)
            before = np.concatenate([[0.0], 1 / r[:-1]])
            if c < 4_096:
                r = (1 + (c - d * (t + 1)) * r) / (before + c - d * t)
                r[t > c] = 0
                c += 1
            else:
                step = min(c // 64, want - c)
                k = step / (before + c - d * t)
                r = (r + k) / (1 + k * (d + before))
                c += step


@dataclass
class Parent:
    """What each dish's parent would give a customer more, after k others: (front + k - discount if it had no table + back) / (whole + k)."""

    front: np.ndarray
    served: np.ndarray
    back: np.ndarray
    whole: np.ndarray
    discount: float

    def __getitem__(self, rows) -> "Parent":
        return Parent(self.front[rows], self.served[rows], self.back[rows], self.whole[rows], self.discount)

    def chance(self, k: np.ndarray) -> np.ndarray:
        """(dishes, k): ``k`` is at least 1."""
        own = self.front[:, None] + k - np.where(self.served, 0.0, self.discount)[:, None]
        return (own + self.back[:, None]) / (self.whole[:, None] + k)


def _uniform(seed: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(seed + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _very_many(c: float, others: float, parent: Parent, d: float, u: float) -> int:
    """Tables of a dish that has thousands of them: the distribution is normal there, around its mode."""

    def slope(t: float) -> float:  # the logarithm of how much likelier one table more is
        lo, hi = -60.0, -1e-9
        for _ in range(60):  # the saddle point of the Stirling number
            q = np.exp(mid := (lo + hi) / 2)
            lo, hi = (mid, hi) if d * (1 - q) * q ** (d - 1) / (1 - q**d) > c / t else (lo, mid)
        stirling = (1 - np.exp(lo) ** d) / (d * (t + 0.5))
        return float(np.log(stirling * (STRENGTH + d * (others + t)) * parent.chance(np.array([t]))[0, 0]))

    lo, hi = 1.0, c
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    step = max(1.0, 0.01 * lo)
    narrow = max((slope(max(1.0, lo - step)) - slope(min(c, lo + step))) / (2 * step), 1e-12)
    return int(np.clip(round(lo + NormalDist().inv_cdf(u) / narrow**0.5), 1, c))


def _ratio_at(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) for one t of each dish, below the table's width."""
    at, ratio = _ratios(d)
    row = np.searchsorted(at, c, "right") - 1
    up = np.minimum(row + 1, len(at) - 1)
    share = np.clip((c - at[row]) / np.maximum(at[up] - at[row], 1), 0, 1)
    return ratio[row, t - 1] * (1 - share) + ratio[up, t - 1] * share


def _many(out: np.ndarray, which: np.ndarray, c: np.ndarray, others: np.ndarray, parent: Parent, d: float, seed: np.ndarray, turn: int) -> np.ndarray:
    """Seats dishes of some hundred tables, whose number is normal around its mode; tells which were such."""
    if not len(which):
        return np.zeros(0, bool)
    most = _ratios(d)[1].shape[1]
    mine, rest, above, whose = c[which], others[which], parent[which], np.arange(len(which))

    def slope(t: np.ndarray) -> np.ndarray:  # the logarithm of how much likelier one table more is
        with np.errstate(divide="ignore"):
            return np.log(_ratio_at(mine, t, d) * (STRENGTH + d * (rest + t)) * above.chance(t[:, None])[whose, 0])

    lo, hi = np.ones(len(which), np.int64), np.minimum(mine, most)
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        more = slope(mid) > 0
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    inside = (lo < most * 3 // 4) & (lo < mine - 1)
    step = np.clip(lo // 16, 1, np.maximum(np.minimum(mine, most) - 1 - lo, 1))
    narrow = np.maximum((slope(np.maximum(lo - step, 1)) - slope(np.minimum(lo + step, np.minimum(mine - 1, most)))) / (2 * step), 1e-9)
    u = _uniform(seed[which], turn)
    edge = np.maximum(slope(lo), 0)
    middle = lo + 0.5 + edge / np.maximum(edge - slope(np.minimum(lo + 1, np.minimum(mine - 1, most))), 1e-9)
    t = np.clip(np.round(middle + _normal(u) / np.sqrt(narrow)), 1, mine).astype(np.int64)
    out[which[inside]] = t[inside]
    return inside


@lru_cache(maxsize=1)
def _bell() -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(-8, 8, 4_001)
    return np.array([NormalDist().cdf(x) for x in grid]), grid


def _normal(u: np.ndarray) -> np.ndarray:
    """The normal distribution's inverse, by a table of its values."""
    return np.interp(u, *_bell())


def seat(c: np.ndarray, others: np.ndarray, parent: Parent, d: float, seed: np.ndarray, turn: int) -> np.ndarray:
    """The number of tables of each dish after all its ``c`` customers were seated anew.

    ``others``: tables of the restaurant's other dishes. The weight of t tables is
    S(c, t) times the product, over the tables beyond the first, of the
    restaurant's weight of a new table and the parent's chance of the dish. Dishes
    are worked on in classes of width, as far as the weights reach.
    """
    out = np.minimum(c, 1).astype(np.int64)
    if not (c > 1).any():
        return out
    at, ratio = _ratios(d)
    two = np.flatnonzero(c == 2)  # one table or two: most dishes
    gain = (STRENGTH + d * (others[two] + 1)) * parent[two].chance(np.ones(1))[:, 0] / (1 - d)
    out[two] += _uniform(seed[two], turn) * (1 + gain) >= 1
    left = np.flatnonzero(c > 2)
    # few customers: all numbers of tables; others: as far as the weights reach, most only a few
    for width, whole in ((4, True), (8, True), (16, True), (8, False), (32, False), (WIDE, False)):
        open_ = []
        mine = left[c[left] <= width] if whole else left
        left = left[c[left] > width] if whole else left[:0]
        for a in range(0, len(mine), max(1, 400_000 // width)):
            g = mine[a : a + max(1, 400_000 // width)]
            k = np.arange(1, min(width, 2_048))
            row = np.searchsorted(at, c[g], "right") - 1
            r = ratio[row, : len(k)]
            far = np.flatnonzero(c[g] > 1_024)
            if len(far):  # between two rows
                up = np.minimum(row[far] + 1, len(at) - 1)
                share = (c[g[far]] - at[row[far]]) / np.maximum(at[up] - at[row[far]], 1)
                r[far] += share[:, None].astype(np.float32) * (ratio[up, : len(k)] - r[far])
            gain = r * (STRENGTH + d * (others[g][:, None] + k)) * parent[g].chance(k)
            weight = np.ones((len(g), len(k) + 1))
            if width <= 32:
                with np.errstate(over="ignore"):
                    np.cumprod(gain, axis=1, out=weight[:, 1:])
            else:
                with np.errstate(divide="ignore"):
                    low = np.cumsum(np.log(gain), axis=1)
                top = np.maximum(low.max(1), 0)
                weight[:, 0], weight[:, 1:] = np.exp(-top), np.exp(low - top[:, None])
            total = np.cumsum(weight, axis=1)
            if not whole:  # the weights must have died away
                cut = ~np.isfinite(total[:, -1]) | (weight[:, -1] > 1e-8 * total[:, -1]) & (c[g] > weight.shape[1])
                open_.append(g[cut])
                g, total = g[~cut], total[~cut]
            x = _uniform(seed[g], turn) * total[:, -1]
            out[g] = 1 + np.minimum((total < x[:, None]).sum(1), c[g] - 1)
        left = np.concatenate([left, *open_]) if open_ else left
    left = left[~_many(out, left, c, others, parent, d, seed, turn)]
    for i in left.tolist():
        out[i] = _very_many(float(c[i]), float(others[i]), parent[[i]], d, float(_uniform(seed[[i]], turn)[0]))
    return out


# ---- shards of tokens


def _planes(values: np.ndarray) -> np.ndarray:
    """Sorted values of 40 bits, byte by byte, which compresses their common heads."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].T).ravel()


def _from_planes(data: np.ndarray) -> np.ndarray:
    planes = data.reshape(5, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, 3:] = planes.T
    return wide.view(">u8").ravel().astype(np.uint64)


def _steps(a: np.ndarray) -> np.ndarray:
    """The differences of numbers that mostly rise, whose sums give them again."""
    return np.diff(a.astype(np.int32), prepend=np.int32(0))


def _small(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _joined(head: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(head * np.uint64(3) ^ mix(word + np.uint64(n)))


def _sorted(keys: np.ndarray, bits: int) -> np.ndarray:
    """An order of the keys by their first ``bits`` bits; the places are sorted along in the bits below, which is much faster than sorting places."""
    low = np.uint64((1 << 64 - bits) - 1)
    if len(keys) > int(low):
        return np.argsort(keys, kind="stable")
    return (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)


def _distinct(h: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values distinct in their first ``bits`` bits, in order; the order, where each value begins in it, and the number of each element."""
    order = _sorted(h, bits) if bits < 64 else np.argsort(h)
    values = h[order]
    new = np.ones(len(h), bool)
    top = values >> np.uint64(64 - bits) if bits < 64 else values
    new[1:] = top[1:] != top[:-1]
    number = np.empty(len(h), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    begin = np.flatnonzero(new)
    return values[begin], order, begin, number


#: Bits by which a shard tells its pairs and triples apart (one clash in some shards), and those that name one in a range.
SHARD_BITS, NAME_BITS = 42, 40


class TokenShard:
    """Whole documents as numbers of the shard's own sorted word hashes; each document ends with END.

    Stored are their places in ``often``, the numbers by falling frequency.
    """

    def __init__(self, doc_ids, known, held, counts, vocab, often, tokens):
        self.doc_ids, self.known, self.held, self.counts, self.vocab, self.tokens = doc_ids, known, held, counts, vocab, often[tokens]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.begin = np.searchsorted(vocab, BEGIN)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[np.repeat(~self.held, self.counts)], minlength=len(self.vocab))

    def number(self) -> None:
        """Pairs and triples by hash: training counts, words of a pair, pairs of a triple, and the triple of each token.

        Before a document stand two BEGIN; ``empty`` is the pair of these, a context but no dish.
        """
        start, train = self.first[:-1], np.repeat(~self.held, self.counts)
        u = np.empty(len(self.tokens), np.int32)
        u[1:] = self.tokens[:-1]
        u[start] = self.begin
        nothing = self.vocab[[self.begin]]
        self.pairs, order, begin, number = _distinct(np.append(_joined(self.vocab[u], self.vocab[self.tokens], 1), _joined(nothing, nothing, 1)), SHARD_BITS)
        self.empty, number = int(number[-1]), number[:-1]
        inside = np.minimum(order[begin], len(u) - 1)
        self.pair_u, self.pair_w = u[inside], self.tokens[inside]
        self.pair_u[self.empty] = self.pair_w[self.empty] = self.begin
        context = np.empty(len(u), np.int32)
        context[1:] = number[:-1]
        context[start] = self.empty
        self.triples, order, begin, self.triple_of = _distinct(_joined(self.pairs[context], self.vocab[self.tokens], 2), SHARD_BITS)
        place = order[begin]
        self.context, self.suffix = context[place], number[place]
        self.pair_counts = np.bincount(number, weights=train, minlength=len(self.pairs)).astype(np.int64)
        self.pair_counts[self.empty] = int((~self.held).sum())
        self.triple_counts = np.bincount(self.triple_of, weights=train, minlength=len(self.triples)).astype(np.int64)


    def totals(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """The answered counts of pairs and triples; one beyond its pairs' comes from two triples of one name and is cut."""
        pairs, triples = _parts(rows, PAIRS, 0), _parts(rows, TRIPLES, 0)
        return pairs, np.minimum(triples, np.minimum(pairs[self.context], pairs[self.suffix]))


    def frequent(self, triple_counts: np.ndarray) -> np.ndarray:
        """The triples that occur twice or more, by context."""
        multi = np.flatnonzero(triple_counts > 1)
        return multi[np.argsort(self.context[multi], kind="stable")]


def token_shards(docs: DataFrame, folds: int, held_fold: int, id_col: str, text_col: str, shard_tokens: int) -> DataFrame:
    """One row for each shard; src is its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tokens, number, part = [], 0, 0, TaskContext.get().partitionId()

        def flush():
            nonlocal parts, tokens, number
            ids, known, held, counts, hashes = (np.concatenate(x) for x in zip(*parts))
            words = np.append(hashes, [END, BEGIN])
            vocab, _, _, local = _distinct(words, SHARD_BITS)
            if (vocab[local] != words).any():  # two words with one beginning
                vocab, _, _, local = _distinct(words)
            often = np.argsort(-np.bincount(local), kind="stable").astype(np.int32)  # small numbers for frequent words
            turn = np.empty_like(often)
            turn[often] = np.arange(len(often))
            row = messages([((part << 32) + number, 0, len(hashes), pack(ids, known, held, counts, vocab, often, turn[local[:-2]]))])
            parts, tokens, number = [], 0, number + 1
            return row

        for b in batches:
            buf, off = utf8(b.column(1))
            known, ids = np.asarray(b.column(0).is_valid()), np.asarray(b.column(0).fill_null(0))
            held = np.asarray(b.column(2).fill_null(False).cast(pa.int8())).astype(bool)
            for lo, hi in chunks(off):
                piece = buf[off[lo] : off[hi]]
                starts, ends, first = word_spans(piece, off[lo : hi + 1] - off[lo])
                h = np.insert(span_hashes(piece, starts, ends), first[1:], END)
                parts.append((ids[lo:hi], known[lo:hi], held[lo:hi], np.diff(first) + 1, h))
                tokens += len(h)
                if tokens >= shard_tokens:
                    yield flush()
        if parts:
            yield flush()

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held")).mapInArrow(run, MESSAGE)


def _together(left: DataFrame, right: DataFrame, handle, schema: str) -> DataFrame:
    """``handle(dest, own payload, [(kind, src, payload)])`` for each row of ``left`` with its messages."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        rows = sorted(zip(got["kind"].to_pylist(), got["src"].to_pylist(), got["payload"].to_pylist()), key=lambda r: r[:2])
        return pa.Table.from_batches([handle(own["dest"][0].as_py(), unpack(own["payload"][0].as_py()), rows)])

    return left.groupBy("dest").cogroup(right.groupBy("dest")).applyInArrow(run, schema)


def _parts(rows, kind: int, i: int) -> np.ndarray:
    """The i-th arrays of the messages of one kind, one after another, as integers."""
    found = [unpack(p)[i] for k, _, p in rows if k == kind]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _sum(number: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(number, weights=weights, minlength=n).astype(np.int64)


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))


# ---- the model


class PitmanYorModel:
    """Training counts and seating of one corpus, and its scores."""

    def __init__(self, docs: DataFrame, folds: int = 7, held_fold: int = 2, rounds: int = 3, burn_in: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS):
        self.rounds, self.burn_in, self.made = rounds, burn_in, {}
        self.spark = docs.sparkSession
        self.shards = self._table(token_shards(docs, folds, held_fold, id_col, text_col, shard_tokens), "shards")
        total = self.shards.agg(F.sum("src")).first()[0] or 0
        self.n_words = max(8, -(-total // (8 * WORDS_A_RANGE)))
        self.n_grams = max(8, -(-total // GRAMS_A_RANGE))
        self._count()
        self._arrange()
        for r in range(1, rounds + 1):
            self._round(r)
        self._drop("states")

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        """A table bucketed by destination in the shared folder: rows are dealt once, and no later round moves them again."""
        table = f"lm_{name}_{uuid.uuid4().hex}"
        folder = f"{shared_folder(self.spark)}/{table}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with without_shuffles(self.spark):
            df.repartition(n, "dest").write.bucketBy(n, "dest").option("path", folder).option("compression", "uncompressed").saveAsTable(table)
        self.made[name] = (table, folder)
        return self.spark.table(table)

    def _drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            table, folder = self.made.pop(name)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            discard(self.spark, [folder])

    def _stats(self, df: DataFrame, n: int) -> list[int]:
        found = dict(df.where(F.col("kind") >= STATS).groupBy("kind").agg(F.sum("src")).collect())
        return [found.get(STATS + i, 0) for i in range(n)]

    def _count(self) -> None:
        """Counts of words, pairs and triples, answered to the shards."""
        n_words, n_grams = self.n_words, self.n_grams
        shift = np.uint64(max(0, 24 - (n_grams - 1).bit_length() + 1))

        def send(batches):
            for b in batches:
                for dest, payload in zip(b.column(0).to_pylist(), b.column(3)):
                    s = TokenShard(*unpack(payload.as_py()))
                    s.number()
                    counts, cuts = s.word_counts(), slices(s.vocab, n_words)
                    out = [(q, WORDS, dest, pack(s.vocab[a:z], _small(counts[a:z]))) for q, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
                    for kind, first, values, counts in ((PAIRS, n_words, s.pairs, s.pair_counts), (TRIPLES, n_words + n_grams, s.triples, s.triple_counts)):
                        cuts = slices(values, n_grams)
                        for q, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                            if z > a:  # 40 bits beyond the range's start name a gram there
                                inside = values[a:z] - np.uint64(q * (1 << 64) // n_grams)
                                out.append((first + q, kind, dest, pack(_planes(inside >> shift), _small(counts[a:z]))))
                    yield messages(out)

        def merge(dest, rows):
            kind = rows[0][0]
            parts = [(src, *unpack(p)) for _, src, p in rows]
            values = np.concatenate([v if kind == WORDS else _from_planes(v) << np.uint64(64 - NAME_BITS) for _, v, _ in parts])
            distinct, order, begin, number = _distinct(values, 64 if kind == WORDS else NAME_BITS)
            cuts = np.cumsum([0] + [len(p[2]) for p in parts])
            src = np.array([p[0] for p in parts], np.int64)
            total = _sum(number, np.concatenate([p[2] for p in parts]), len(distinct))
            if kind == WORDS:
                out = [(p[0], kind, dest, pack(_small(total[number[a:z]]))) for p, a, z in zip(parts, cuts[:-1], cuts[1:])]
                out.append((dest, STATE, 0, pack(distinct, src, cuts, _steps(number))))
                out += [(dest, STATS, int(total.sum()), b""), (dest, STATS + 1, int((total > 0).sum()), b"")]
                yield messages(out)
                return
            # one holder of each gram owns it: that of the element whose turn the gram's hash says
            holders = np.diff(np.append(begin, len(order))).astype(np.uint64)
            owner = np.zeros(len(number), bool)
            owner[order[begin + (mix(distinct) % holders).astype(np.int64)]] = True
            out = [(p[0], kind, dest, pack(_small(total[number[a:z]]), np.packbits(owner[a:z]))) for p, a, z in zip(parts, cuts[:-1], cuts[1:])]
            if kind == PAIRS:  # later messages are about the pairs that occur twice or more
                many = total > 1
                held = many[number]
                cuts = np.concatenate([[0], np.cumsum(held)])[cuts]
                out.append((dest, STATE, 0, pack(np.array([int(many.sum())]), src, cuts, _steps((np.cumsum(many) - 1)[number[held]]))))
                out.append((dest, STATS + 2, int((total == 1).sum()), b""))
            else:
                out += [(dest, STATS + 3, int((total == 1).sum()), b""), (dest, STATS + 4, int((total == 2).sum()), b"")]
            yield messages(out)

        # written first as it comes, so that the large messages are gone before the answers are dealt
        merged = stored(by_destination(self.shards.mapInArrow(send, MESSAGE), merge, MESSAGE), "lm-merged", folders := [])
        done = self._table(merged, "counts")
        discard(self.spark, folders)
        self.tokens, self.vocabulary, self.single_pairs, one, two = self._stats(done, 5)
        self.d3 = _discount(one, two)
        self.ranges = done.where(F.col("kind") == STATE)
        self.answers = done.where(F.col("kind").isin(WORDS, PAIRS, TRIPLES))

    def _arrange(self) -> None:
        """The shards' compact state, and the first seating: each dish has one table."""
        n_words, n_grams = self.n_words, self.n_grams

        def arrange(dest, payload, rows):
            s = TokenShard(*payload)
            s.number()
            c2, c3 = s.totals(rows)
            own2, own3 = (np.concatenate([np.unpackbits(unpack(p)[1], count=len(unpack(p)[0])) for k, _, p in rows if k == kind]).astype(bool) for kind in (PAIRS, TRIPLES))
            many = c2 > 1
            place = np.where(many, np.cumsum(many) - 1, -1)
            n, v = int(many.sum()), len(s.vocab)
            # owned grams of one customer: what they give to pairs and words in each round
            lone = np.flatnonzero((c3 == 1) & own3)
            to = place[s.suffix[lone]]
            base_c = np.bincount(to[to >= 0], minlength=n)
            to = place[s.context[lone]]
            base_t = np.bincount(to[to >= 0], minlength=n)
            base_seats = np.bincount(s.pair_u[s.suffix[lone]], minlength=v)
            alone = (c2 == 1) & own2
            alone[s.empty] = False
            base_u, base_w = np.bincount(s.pair_u[alone], minlength=v), np.bincount(s.pair_w[alone], minlength=v)
            multi = s.frequent(c3)
            edges = np.searchsorted(np.flatnonzero(many), slices(s.pairs, n_grams))
            state = (
                (s.vocab >> np.uint64(32)).astype(np.uint32), slices(s.vocab, n_words), edges,
                s.pair_u[many], s.pair_w[many], np.packbits(own2[many]), _small(base_c), _small(base_t),
                _small(base_u), _small(base_w), _small(base_seats),
                _steps(place[s.context[multi]]), place[s.suffix[multi]].astype(np.int32), _small(c3[multi]), np.packbits(own3[multi]),
            )
            shard = Seating(n_words, *state)
            out = shard.report(dest, shard.pairs_own, shard.triples_own.astype(np.int64))
            return messages([(dest, STATE, 0, pack(*state)), *out])

        made = self._table(_together(self.shards, self.answers, arrange, MESSAGE), "states")
        self.states = made.where(F.col("kind") == STATE)
        self.replies: list[DataFrame] = []
        self.seated: list[DataFrame] = [self.states.where("false")]
        self.tables_of_words = self.ranges.where("false")
        self.d1 = self.d2 = None
        self.roots: list[tuple[int, int]] = []
        self._add_up(made.where(F.col("kind") == TABLES), 0)

    def _add_up(self, reports: DataFrame, r: int) -> None:
        """The ranges add the reports up, seat the words, and answer the shards."""
        n_words, vocabulary, d1 = self.n_words, self.vocabulary, self.d1
        before = self.roots[-1][1] if self.roots else 0

        def add(dest, payload, rows):
            """A range's sums; the words of a range are seated here."""
            sent = {src: unpack(p) for kind, src, p in rows if kind == TABLES}
            if dest < n_words:
                distinct, senders, cuts, number = payload
                n, fields = len(distinct), 3
            else:
                (n,), senders, cuts, number = payload
                n, fields = int(n), 2
            number = np.cumsum(number.astype(np.int32), dtype=np.int32)
            sums = [np.zeros(n, np.int64) for _ in range(fields)]
            for src, a, z in zip(senders.tolist(), cuts[:-1], cuts[1:]):
                for i in range(fields):
                    if z > a:
                        sums[i] += _sum(number[a:z], sent[src][i], n)
            out = []
            if dest < n_words:
                c_w = sums[2]
                old = _parts(rows, SEATED, 0)
                if len(old):
                    uniform = Parent(np.zeros(n), np.ones(n, bool), np.full(n, 1e15 / (vocabulary + 1)), np.full(n, 1e15), 0.0)
                    t_w = seat(c_w, np.maximum(before - old, 0), uniform, d1, distinct, r)
                else:
                    t_w = np.minimum(c_w, 1)
                sums.append(t_w)
                out += [(dest, SEATED, 0, pack(_small(t_w))), (dest, STATS, int(c_w.sum()), b""), (dest, STATS + 1, int(t_w.sum()), b"")]
                ones = c_w
            else:
                ones = sums[0]
            out += [(dest, STATS + (2 if dest < n_words else 4) + i, int((ones == i + 1).sum()), b"") for i in range(2)]
            kind = WORDS if dest < n_words else PAIRS
            out += [(src, kind, dest, pack(*(_small(x[number[a:z]]) for x in sums))) for src, a, z in zip(senders.tolist(), cuts[:-1], cuts[1:]) if z > a]
            return messages(out)

        done = self._table(_together(self.ranges, reports.unionByName(self.tables_of_words), add, MESSAGE), f"tables{r}")
        customers, tables, w1, w2, p1, p2 = self._stats(done, 6)
        if r == 0:  # discounts by the customers of the first seating
            self.d1, self.d2 = _discount(w1, w2), _discount(p1 + self.single_pairs, p2)
        self.roots.append((customers, tables))
        self.tables_of_words = done.where(F.col("kind") == SEATED)
        self.replies.append(done.where(F.col("kind").isin(WORDS, PAIRS)))

    def _round(self, r: int) -> None:
        """One round: shards seat pairs and triples, ranges add up and seat words."""
        n_words, d1, d2, d3, vocabulary, root = self.n_words, self.d1, self.d2, self.d3, self.vocabulary, self.roots[-1]

        def sweep(dest, payload, rows):
            shard = Seating(n_words, *payload)
            c, t_u = _parts(rows, PAIRS, 0), _parts(rows, PAIRS, 1)
            words = [_parts(rows, WORDS, i) for i in range(4)]
            tables_v, seats_v, c_w, t_w = words
            old = [unpack(p) for kind, _, p in rows if kind == SEATED]
            old2, old3 = (x.astype(np.int64) for x in old[0]) if old else (np.minimum(c, 1), np.ones(len(shard.c3), np.int64))
            # pairs, with their tables taken out of the word before and of the word itself
            mine = np.minimum(old2, c)
            rest = np.maximum(c_w[shard.w] - mine, 0)
            top = Parent(np.where(rest > 0, np.maximum(rest - d1 * np.minimum(t_w[shard.w], rest), 0), 0.0), rest > 0, np.full(len(c), (STRENGTH + d1 * root[1]) / (vocabulary + 1)), STRENGTH + np.maximum(root[0] - mine, 0), d1)
            new2 = seat(c, np.maximum(tables_v[shard.u] - mine, 0), top, d2, shard.seed2, r)
            # triples, likewise, below the pairs as they are now
            p_w = (np.maximum(c_w - d1 * t_w, 0) + (STRENGTH + d1 * root[1]) / (vocabulary + 1)) / (STRENGTH + root[0])
            back = (STRENGTH + d2 * np.maximum(tables_v[shard.u] - mine + new2, 0)) * p_w[shard.w]
            q = shard.suffix
            rest = np.maximum(c[q] - old3, 0)
            pair = Parent(np.where(rest > 0, np.maximum(rest - d2 * np.minimum(new2[q], rest), 0), 0.0), rest > 0, back[q], STRENGTH + np.maximum(seats_v[shard.u[q]] - old3, 0), d2)
            new3 = seat(shard.c3.astype(np.int64), np.maximum(t_u[shard.context] - old3, 0), pair, d3, shard.seed3, r)
            out = shard.report(dest, np.where(shard.pairs_own, new2, 0), np.where(shard.triples_own, new3, 0))
            return messages([(dest, SEATED, r, pack(_small(new2), _small(new3))), *out])

        done = self._table(_together(self.states, self.replies[-1].unionByName(self.seated[-1]), sweep, MESSAGE), f"seated{r}")
        self.seated.append(done.where(F.col("kind") == SEATED))
        self._add_up(done.where(F.col("kind") == TABLES), r)
        old = r - 1  # nothing reads the tables of a round before the burn-in's last any more
        if old < self.burn_in:
            self._drop(f"tables{old}")
        if 1 <= old <= self.burn_in:
            self._drop(f"seated{old}")

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document."""
        d1, d2, d3, tokens, vocabulary, burn_in, roots, rounds = self.d1, self.d2, self.d3, self.tokens, self.vocabulary, self.burn_in, self.roots, self.rounds
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

        def score(dest, payload, rows):
            s = TokenShard(*payload)
            s.number()
            at = lambda r: [(k % STATS, src, p) for k, src, p in rows if k // STATS == r]
            counts = at(0)
            c_word, (c2, c3) = _parts(counts, WORDS, 0), s.totals(counts)
            many, multi = np.flatnonzero(c2 > 1), s.frequent(c3)
            p = np.zeros(len(c3))
            for r in range(burn_in + 1, rounds + 1):
                # the pairs' customers and the words' seats are those that round r seated
                before, now = at(r), at(r + 1)
                c, t, tables, t3 = np.minimum(c2, 1), np.minimum(c2, 1), np.minimum(c2, 1), np.minimum(c3, 1)
                c[many], tables[many] = _parts(before, PAIRS, 0), _parts(now, PAIRS, 1)
                seats = _parts(before, WORDS, 1)
                tables_v, _, c_w, t_w = (_parts(now, WORDS, i) for i in range(4))
                t[many], t3[multi] = (_parts(now, SEATED, i) for i in range(2))
                p_w = (np.maximum(c_w - d1 * t_w, 0) + (STRENGTH + d1 * roots[r][1]) / (vocabulary + 1)) / (STRENGTH + roots[r][0])
                p_pair = (c - d2 * t + (STRENGTH + d2 * tables_v[s.pair_u]) * p_w[s.pair_w]) / (STRENGTH + seats[s.pair_u])
                p += (c3 - d3 * t3 + (STRENGTH + d3 * tables[s.context]) * p_pair[s.suffix]) / (STRENGTH + c2[s.context])
            log_p = np.log10(p / (rounds - burn_in))[s.triple_of]
            base = np.log10((c_word + 1) / (tokens + vocabulary + 1))[s.tokens]
            begin = s.first[:-1]
            total = np.add.reduceat(log_p, begin)
            return pa.record_batch(
                [
                    pa.array(s.doc_ids, pa.int64(), mask=~s.known),
                    pa.array(s.held),
                    pa.array(s.counts, pa.int64()),
                    pa.array(np.add.reduceat((c_word[s.tokens] > 0).astype(np.int64), begin)),
                    pa.array(np.full(len(begin), int(tokens)), pa.int64()),
                    pa.array(np.add.reduceat(base, begin)),
                    pa.array(total),
                    pa.array(10 ** (-total / s.counts)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

        got = self.answers
        for r in range(burn_in, rounds + 1):  # what came of round r has its kind moved by r + 1 times STATS
            for table in (self.replies[r], self.seated[r])[: 1 + (r > burn_in)]:
                got = got.unionByName(table.withColumn("kind", F.col("kind") + STATS * (r + 1)))
        return _together(self.shards, got, score, schema)

    def close(self) -> None:
        """Removes the model's tables; read the scores before."""
        self._drop(*list(self.made))


class Seating:
    """A shard's pairs and triples that occur twice or more, and what the others add to the sums."""

    def __init__(self, n_words, seeds, word_cuts, pair_cuts, u, w, own2, base_c, base_t, base_u, base_w, base_seats, context, suffix, c3, own3):
        context = np.cumsum(context, dtype=np.int32)
        self.word_cuts, self.pair_cuts, self.u, self.w, self.context, self.suffix, self.c3, self.n_words = word_cuts, pair_cuts, u, w, context, suffix, c3, n_words
        self.bases = base_c, base_t, base_u, base_w, base_seats
        self.pairs_own = np.unpackbits(own2, count=len(u)).astype(np.int64)
        self.triples_own = np.unpackbits(own3, count=len(c3)).astype(np.int64)
        self.seed2 = _joined(seeds[u].astype(np.uint64), seeds[w].astype(np.uint64), 1)
        self.seed3 = _joined(self.seed2[context], seeds[w[suffix]].astype(np.uint64), 2)

    def report(self, dest: int, tables2: np.ndarray, tables3: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        """Messages to the ranges: tables of owned grams as customers of their parents and tables of their contexts."""
        base_c, base_t, base_u, base_w, base_seats = self.bases
        n, v = len(self.u), len(base_u)
        c = base_c + _sum(self.suffix, tables3, n)
        t = base_t + _sum(self.context, tables3, n)
        words = base_u + _sum(self.u, tables2, v), base_seats + _sum(self.u[self.suffix], tables3, v), base_w + _sum(self.w, tables2, v)
        out = [(q, TABLES, dest, pack(*(_small(x[a:z]) for x in words))) for q, (a, z) in enumerate(zip(self.word_cuts[:-1], self.word_cuts[1:])) if z > a]
        cuts = zip(self.pair_cuts[:-1], self.pair_cuts[1:])
        return out + [(self.n_words + q, TABLES, dest, pack(_small(c[a:z]), _small(t[a:z]))) for q, (a, z) in enumerate(cuts) if z > a]


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """Fits the model on the training documents and scores all of them.

    Held out is a document whose crc32 of the id as text leaves ``held_fold``
    modulo ``folds``; a null id is training. A null or empty text is its end
    token alone. Repeated rows are repeated training text and get equal scores. An
    empty table gives no rows. Other columns are ignored.
    """
    model = PitmanYorModel(docs, **options)
    out = stored(model.scores(), "lm-scores")
    model.close()
    return out


def op1_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Every document's score by the model of the documents that are not held out."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
