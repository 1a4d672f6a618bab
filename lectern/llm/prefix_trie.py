"""Conversation prefix trie over rebuilt conversations, by composable fingerprints.

A sequence of turns has a fingerprint in a monoid: its length n and, in four prime
fields, the sum of turn * base**position. (n, f) followed by (m, g) is
(n + m, f + base**n * g). Running products of the stored turns are made once; the
prefix of a rebuilt conversation is the product of a head of its base and a
stretch of its own turns, which is the quotient of two of its running products.
So no rebuilt conversation is ever written out: a rebuilt turn is a row of numbers
with a reference to the stored turn.

A node of the trie is a group of rebuilt prefixes with one depth and fingerprint.
Each group is verified from the top: all members refer to stored turns of one
class, and all have the same parent group; classes of stored turns are verified by
their texts. Where a check fails the fingerprints are made anew with other bases.

What a node needs from its subtree comes without walking the trie. Members shrink
with depth, so a conversation is the smallest member of its nodes from some depth
on, its own part. Every node is in exactly one own part: sums over the nodes below
are sums over members, of what lies deeper in the conversation (each node as often
as it has members) less what lies deeper in its own part (each node once).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, stored

#: The four fields, the largest primes below 2**31: products of two residues fit a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_P = np.array(PRIMES, np.uint64)
LANES = range(len(PRIMES))
#: Sub-keys of the members of a node in joins; a node uses as many as it has members, up to this number.
SALTS = 1024
#: Turns of one conversation that are joined with its row under one key.
BLOCK_TURNS = 20_000
#: Bytes of ids that travel as one piece to the digest of a node.
PIECE_BYTES = 60_000
_STEP = 1 << 16


class Bases:
    """The bases of the four fields for a seed, with tables of their powers."""

    def __init__(self, seed: int):
        self.bases = [int(b) for b in np.random.default_rng([seed, 77]).integers(1 << 20, (1 << 31) - (1 << 20), len(PRIMES))]
        self._tables: list[np.ndarray] = []

    def _table(self, level: int) -> np.ndarray:
        """(2**16, lanes): powers of base**(2**(16 * level))."""
        while len(self._tables) <= level:
            first = np.array([pow(b, _STEP ** len(self._tables), p) for b, p in zip(self.bases, PRIMES)], np.uint64)
            t, up = np.ones((1, len(PRIMES)), np.uint64), first
            while len(t) < _STEP:
                t, up = np.concatenate([t, t * up % _P]), up * up % _P
            self._tables.append(t)
        return self._tables[level]

    def power(self, n: np.ndarray) -> np.ndarray:
        """(len(n), lanes): base**n."""
        out, level, left = self._table(0)[n % _STEP], 0, n // _STEP
        while left.any():
            level += 1
            out = out * self._table(level)[left % _STEP] % _P
            left = left // _STEP
        return out

    def inverse(self, n: int) -> list[int]:
        return [pow(b, -n, p) for b, p in zip(self.bases, PRIMES)]


def compose(bases: Bases, a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """The fingerprint of one sequence followed by another."""
    return a[0] + b[0], [(f + pow(r, a[0], p) * g) % p for f, g, r, p in zip(a[1], b[1], bases.bases, PRIMES)]


def _lanes(name: str) -> list[str]:
    return [f"{name}{k}" for k in LANES]


def _packed(lanes: list[Column]) -> list[Column]:
    """Four residues as two longs."""
    return [F.shiftleft(lanes[0], 32).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 32).bitwiseOR(lanes[3])]


def stored_turns(turns: DataFrame, seed: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, c1, c2, w): the turns with their class, 128 bits of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long")
    return rows.withColumns({"c1": F.xxhash64(F.lit(seed), "role", "text"), "c2": F.xxhash64(F.lit(~seed), "text", "role"), "w": words})


def running_products(rows: DataFrame, bases: Bases) -> DataFrame:
    """(pid, conv, ord, w, upto, c1, c2, f0.., g0..): place, words and fingerprint up to each turn, and fingerprint before it.

    The turns are dealt by ranges of (conv, turn, role, digest of the text), so a
    long conversation lies in many partitions; the numbers count within a
    partition, ``pid``, and ``with_offsets`` completes them.
    """
    slim = rows.select("conv", "turn", "role", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("tie"), "w", "c1", "c2")
    order = ["conv", "turn", "role", "digest", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, n, words, lanes = TaskContext.get().partitionId(), None, 0, 0, np.zeros(len(PRIMES), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            conv, w, c1, c2 = (np.asarray(b.column(k)) for k in range(4))
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            if new[0]:
                n, words, lanes = 0, 0, np.zeros(len(PRIMES), np.uint64)
            new[0] = True
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            first = start == 0  # rows of the conversation that the batch before may have begun
            place = np.arange(len(conv)) - start + 1 + np.where(first, n, 0)
            c1, c2 = c1.view(np.uint64), c2.view(np.uint64)
            leaf = np.stack([c1 >> np.uint64(32), c1 & np.uint64(0xFFFFFFFF), c2 >> np.uint64(32), c2 & np.uint64(0xFFFFFFFF)], 1) % _P
            term = leaf * bases.power(place) % _P
            sums = np.cumsum(term, 0)
            f = (sums - sums[start] + term[start] + np.where(first[:, None], lanes, np.uint64(0))) % _P
            g = (f + _P - term) % _P
            total = np.cumsum(w)
            upto = total - total[start] + w[start] + np.where(first, words, 0)
            last, n, words, lanes = conv[-1], int(place[-1]), int(upto[-1]), f[-1]
            numbers = [pa.array(x.astype(np.int64)) for x in (place, w, upto)] + [b.column(2), b.column(3)] + [pa.array(x[:, k].astype(np.int64)) for x in (f, g) for k in LANES]
            yield pa.record_batch([pa.array(np.full(len(conv), pid, np.int32)), b.column(0), *numbers], names)

    names = ["pid", "conv", "ord", "w", "upto", "c1", "c2", *_lanes("f"), *_lanes("g")]
    sorted_rows = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "w", "c1", "c2")
    return sorted_rows.mapInArrow(run, "pid int, " + ", ".join(f"{c} long" for c in names[1:]))


def with_offsets(running: DataFrame, bases: Bases) -> DataFrame:
    """The running numbers of whole conversations.

    Only the first conversation of a partition can have turns in earlier ones: one
    row for each partition goes to the driver, which composes them.
    """
    ends = running.groupBy("pid").agg(F.min("conv").alias("low"), F.max(F.struct("conv", "ord", "upto", *_lanes("f"))).alias("end")).orderBy("pid").collect()
    carried, rows = (None, 0, 0, [0] * len(PRIMES)), []
    for pid, low, end in ends:
        own = (end.conv, end.ord, end.upto, [end[f"f{k}"] for k in LANES])
        if carried[0] == low:
            rows.append((pid, low, *carried[1:3], *carried[3], *(int(x) for x in bases.power(np.array([carried[1]]))[0])))
        if carried[0] == end.conv:
            n, lanes = compose(bases, (carried[1], carried[3]), (own[1], own[3]))
            own = (end.conv, n, carried[2] + own[2], lanes)
        carried = own
    if not rows:
        return running
    offsets = running.sparkSession.createDataFrame(rows, "pid int, conv long, n0 long, w0 long, " + ", ".join(f"{c} long" for c in _lanes("o") + _lanes("m")))
    both = running.join(F.broadcast(offsets), ["pid", "conv"], "left")  # at most one row for each partition
    moved = lambda c, k: F.when(F.col("n0").isNull(), F.col(c)).otherwise((F.col(f"o{k}") + F.col(f"m{k}") * F.col(c)) % PRIMES[k]).alias(c)
    return both.select(
        "conv",
        (F.col("ord") + F.coalesce("n0", F.lit(0))).alias("ord"),
        "w",
        (F.col("upto") + F.coalesce("w0", F.lit(0))).alias("upto"),
        "c1",
        "c2",
        *[moved(f"{c}{k}", k) for c in "fg" for k in LANES],
    )


def conversation_rows(products: DataFrame, heads_of: int, most: int) -> DataFrame:
    """(conv, n, h, items, hb, own, end, words): each conversation with the head that it takes from its base.

    ``items`` are the first ``hb`` <= ``h`` < ``most`` turns of the base, ``own`` the
    running numbers of its own first ``h`` turns, ``end`` and ``words`` those of the
    rebuilt conversation.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    held = products.groupBy("conv").agg(
        F.max("ord").alias("n"), F.max("upto").alias("total"), F.max(F.when(F.col("ord") <= h, F.struct("ord", "upto", *_lanes("f")))).alias("own")
    )
    item = F.struct("ord", "w", "upto", "c1", "c2", *_lanes("f"), *_lanes("g"))
    heads = products.where((F.col("conv") % heads_of == 0) & (F.col("ord") < most)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(item)).alias("head"))
    both = held.select("*", h.cast("int").alias("h"), (F.col("conv") - F.col("conv") % heads_of).alias("base")).join(heads.hint("merge"), "base", "left")
    taken = both.select("*", F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), F.col("h"))).alias("items"))
    last = F.try_element_at("items", F.lit(-1))
    return taken.select(
        "conv", "n", "h", "items", "own", "base", F.size("items").alias("hb"),
        (F.size("items") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("end"),
        (F.coalesce(last["upto"], F.lit(0)) + F.when(F.col("n") > F.col("h"), F.col("total") - F.coalesce("own.upto", F.lit(0))).otherwise(0)).alias("words"),
    )


def rebuilt_rows(products: DataFrame, convs: DataFrame, bases: Bases, most: int) -> DataFrame:
    """(conv, depth, k1, k2, q1, q2, w, before, end, words, c1, c2, turn_conv, turn_ord): every turn of every rebuilt conversation.

    (k1, k2) is the fingerprint of the prefix that ends here, (q1, q2) of its parent;
    ``before`` counts the words above; (turn_conv, turn_ord) is the stored turn.
    """
    head = convs.select("conv", "base", "end", "words", F.explode("items").alias("t"))
    heads = head.select(
        "conv", F.col("t.ord").alias("depth"), *_packed([F.col(f"t.f{k}") for k in LANES]), *_packed([F.col(f"t.g{k}") for k in LANES]),
        "t.w", F.col("t.upto") - F.col("t.w"), "end", "words", "t.c1", "t.c2", "base", "t.ord",
    )
    last = F.try_element_at("items", F.lit(-1))
    zero = F.lit(0).cast("long")
    few = convs.where("n > h").select(
        "conv", "h", "hb", "end", "words", F.coalesce(last["upto"], zero).alias("head_words"), F.coalesce("own.upto", zero).alias("own_words"),
        *[F.coalesce(last[f"f{k}"], zero).alias(f"a{k}") for k in LANES], *[F.coalesce(f"own.f{k}", zero).alias(f"b{k}") for k in LANES],
        F.explode(F.sequence(zero, F.floor(F.col("n") / BLOCK_TURNS))).alias("block"),
    )
    own = products.withColumn("block", F.floor(F.col("ord") / BLOCK_TURNS)).join(few.hint("merge"), ["conv", "block"]).where("ord > h")
    shift = F.col("h") - F.col("hb")
    inverses = [bases.inverse(d) for d in range(most)]

    def moved(c: str, k: int) -> Column:
        """Head times the quotient of two running products, at its new place."""
        by = F.element_at(F.array(*[F.lit(v[k]).cast("long") for v in inverses]), (shift + 1).cast("int"))
        return (F.col(f"a{k}") + F.pmod(F.col(f"{c}{k}") - F.col(f"b{k}"), F.lit(PRIMES[k])) * by) % PRIMES[k]

    owns = own.select(
        "conv", F.col("ord") - shift, *_packed([moved("f", k) for k in LANES]), *_packed([moved("g", k) for k in LANES]),
        "w", F.col("head_words") + F.col("upto") - F.col("w") - F.col("own_words"), "end", "words", "c1", "c2", "conv", "ord",
    )
    names = ["conv", "depth", "k1", "k2", "q1", "q2", "w", "before", "end", "words", "c1", "c2", "turn_conv", "turn_ord"]
    return heads.toDF(*names).unionByName(owns.toDF(*names))


_NODE = ["depth", "k1", "k2"]
_SAME = ("c1", "c2", "q1", "q2")


def broken_groups(nodes: DataFrame) -> int:
    """The number of groups whose members differ in the last turn's class or in the parent group."""
    return nodes.where(" or ".join(f"{c}_low <> {c}_high" for c in _SAME)).count()


def broken_classes(turns: DataFrame, made: list[str]) -> int:
    """The number of classes whose stored turns differ in role or text. Only classes of several turns are compared."""
    salted = turns.select("c1", "c2", "role", "text", F.pmod(F.xxhash64("conv", "turn"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = salted.groupBy("c1", "c2", "salt").agg(F.count("*").alias("n"))
    several = parts.groupBy("c1", "c2").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1").select("c1", "c2", F.explode("salts").alias("salt"))
    twins = salted.join(several.hint("merge"), ["c1", "c2", "salt"], "left_semi").select("c1", "c2", F.struct("role", "text").alias("t"))
    return twins.groupBy("c1", "c2").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").count()


def with_smallest(rows: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with the smallest member of their node and the end of its longest, and the nodes with the ranges to verify."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))
    ranges = [f(c).alias(f"{c}_{name}") for c in _SAME for f, name in ((F.min, "low"), (F.max, "high"))]
    parts = salted.groupBy(*_NODE, "salt").agg(F.min("conv").alias("m"), F.max("end").alias("longest"), *ranges)
    again = [f(f"{c}_{name}").alias(f"{c}_{name}") for c in _SAME for f, name in ((F.min, "low"), (F.max, "high"))]
    nodes = stored(parts.groupBy(*_NODE).agg(F.min("m").alias("m"), F.max("longest").alias("longest"), F.collect_list("salt").alias("salts"), *again), "trie-nodes", made)
    each = nodes.select(*_NODE, "m", "longest", F.explode("salts").alias("salt"))
    return salted.join(each.hint("merge"), [*_NODE, "salt"]).drop("salt"), nodes


def end_digests(ends: DataFrame) -> DataFrame:
    """(m, depth, ends_sha256) from (m, depth, conv): the digest of a node's ended conversations, ascending.

    Ids are sorted by ranges and joined to pieces there, so that a node of very
    many conversations sends few rows; its digest, which is sequential, reads the
    pieces as a stream.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size = None, [], 0
        out: list[tuple[int, int, int, str]] = []
        for b in batches:
            for m, depth, conv in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (m, depth) != node or size > PIECE_BYTES:
                    if held:
                        out.append((*node, held[0], ",".join(map(str, held))))
                    node, held, size = (m, depth), [], 0
                held.append(conv)
                size += 20
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], ["m", "depth", "first", "ids"])
                out = []
        if held:
            yield pa.record_batch([pa.array([x]) for x in (*node, held[0], ",".join(map(str, held)))], ["m", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for m, depth, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (m, depth) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (m, depth), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], ["m", "depth", "ends_sha256"])
                out = []
        if node:
            yield pa.record_batch([pa.array([x]) for x in (*node, sha.hexdigest())], ["m", "depth", "ends_sha256"])

    order = ["m", "depth", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "m long, depth long, first long, ids string")
    dealt = pieces.repartition("m", "depth").sortWithinPartitions("m", "depth", "first").select("m", "depth", "ids")
    return dealt.mapInArrow(digest, "m long, depth long, ends_sha256 string")


def _rebuilt(turns: DataFrame, columns: tuple[str, ...], heads_of: int, most: int, made: list[str], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """The conversations, and their rebuilt rows with the smallest members, verified."""
    spark = turns.sparkSession
    for seed in range(attempts):
        mine: list[str] = []
        bases, rows = Bases(seed), stored_turns(turns, seed, *columns)
        products = with_offsets(stored(running_products(rows, bases), "trie-products", mine), bases)
        convs = stored(conversation_rows(products, heads_of, most), "trie-conversations", mine)
        prefixes = stored(rebuilt_rows(products, convs, bases, most), "trie-prefixes", mine)
        known, nodes = with_smallest(prefixes, mine)
        if not broken_groups(nodes) and not broken_classes(rows, mine):
            made += mine
            return convs, stored(known, "trie-members", made)
        discard(spark, mine)
    raise RuntimeError(f"fingerprints of different turns agree under {attempts} seeds")


def prefix_trie(turns: DataFrame, heads_of: int = 20, most: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv, turn_ord): the trie's nodes.

    A conversation c takes the first h turns of conversation c - c % ``heads_of``,
    with h = crc32(c) % ``most``, and goes on with its own turns after its first h.
    ``turn_conv`` and ``turn_ord`` name a stored turn with the node's last role and
    text (null for the root).

    Null roles and texts are empty, null turns come first, rows with the same turn
    are ordered by role and the MD5 of the text, repeated rows are repeated turns,
    rows with a null conversation belong to none and are left out, other columns
    are ignored. % keeps the sign of c. An empty table gives no rows. A
    conversation's turns, a node's members and its ended ids may be any number:
    none is brought together in one row.
    """
    made: list[str] = []
    spark = turns.sparkSession
    convs, rows = _rebuilt(turns, (conv_col, turn_col, role_col, text_col), heads_of, most, made)
    smallest = convs.agg(F.min("conv")).first()[0]
    conv, depth, end, m = F.col("conv"), F.col("depth"), F.col("end"), F.col("m")
    mine = m == conv
    info = rows.groupBy("conv").agg(
        F.min(F.when(mine, depth)).alias("o"),
        F.min(F.when(mine, F.col("before"))).alias("above"),
        F.max(F.when(~mine, m)).alias("parent"),
        F.max((mine & (depth == end) & (F.col("longest") == end)).cast("long")).alias("leaf"),
    )
    known = convs.select("conv", "end", "words").join(info.hint("merge"), "conv", "left").select(
        "conv", "end",
        F.coalesce("o", F.col("end") + 1).alias("o"), F.coalesce("above", "words").alias("above"),
        F.coalesce("parent", F.lit(smallest)).alias("parent"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    known = stored(known, "trie-owners", made)
    blocks = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / BLOCK_TURNS))).alias("block")).drop("end")
    all_rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK_TURNS)).join(blocks.hint("merge"), ["conv", "block"])
    o, below = F.col("o"), F.col("depth") + 1
    child = (o <= below) & (below <= end)
    nodes = all_rows.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(o <= depth, F.when(depth > o, conv).otherwise(F.col("parent")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest("before", "above") - F.col("before")).alias("saved_tokens"),
        F.min(F.struct("turn_conv", "turn_ord")).alias("turn"),
    )
    nodes = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn.turn_conv", "turn.turn_ord")
    first = (o <= 1) & (F.col("end") >= 1)
    none = F.lit(None).cast("long")
    root = known.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(first.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("above").alias("saved_tokens"))
    root = root.where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", none.alias("turn_conv"), none.alias("turn_ord"),
    )
    ends = rows.where("depth = end").select("m", "depth", "conv").unionByName(convs.where("end = 0").select(F.lit(smallest).cast("long").alias("m"), F.lit(0).cast("long").alias("depth"), "conv"))
    digests = end_digests(ends).withColumnRenamed("m", "conv_id")
    out = nodes.unionByName(root).join(digests.hint("merge"), ["conv_id", "depth"], "left")
    result = stored(
        out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "turn_conv", "turn_ord",
        ),
        "prefix-trie",
    )
    discard(spark, made)
    return result


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("turn_conv", "turn_ord")


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT c, c - c % 20 AS base FROM turns
), crcs AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM convs
), lists AS (
  SELECT c, list({'r': role, 't': text} ORDER BY k) AS l FROM turns GROUP BY c
), rebuilt AS (
  SELECT r.c, list_concat(coalesce(b.l, [])[1:r.h], o.l[r.h + 1:]) AS path
  FROM crcs r JOIN lists o ON o.c = r.c LEFT JOIN lists b ON b.c = r.base
), prefixes AS (
  SELECT c, len(path) AS n, unnest(range(len(path) + 1)) AS d, path FROM rebuilt
), nodes AS (
  SELECT path[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS childless,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends,
    (count(*) - 1) * any_value(CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(path[d].t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END) AS saved
  FROM prefixes GROUP BY path[1:d], d
)
SELECT u.conv_id, u.d::BIGINT AS depth, any_value(q.conv_id) AS parent_conv_id, any_value(u.n_convs) AS n_convs,
  count(*) FILTER (v.d = u.d + 1) AS n_children, count(*) FILTER (v.childless) AS n_leaves,
  sum(v.saved)::BIGINT AS saved_tokens, sha256(any_value(u.ends)) AS ends_sha256
FROM nodes u JOIN nodes v ON v.p[1:u.d] = u.p LEFT JOIN nodes q ON q.d = u.d - 1 AND q.p = u.p[1:u.d - 1]
GROUP BY u.p, u.d, u.conv_id
"""
