"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton is compiled merge by merge. Its letters are bytes, the last byte
of a word being a letter of its own. At the start every base symbol may follow
every other. The gadget of the merge (u, v) -> w takes away, from every symbol
that ends in a live u, the way to those that begin with a live v, and adds the
symbol w, whose way in is that of u and whose way out is that of v. A merge whose
own way u -> v is gone by then can never fire; its token gets no state.

Spelling the tokens out byte by byte makes that automaton nondeterministic, and
the subset construction makes it deterministic again: a state is the set of
(token before, spelling so far) that the bytes read leave open. In each state
exactly one open spelling is complete, the last token of the encoding of what
was read, and that token is the label of the arc. ``compile`` fills the table
(state, byte) -> (state, label) along all spellings of the vocabulary; an arc
beyond these is added when it is first needed. Encoding is one table look-up a
byte and one walk back over the labels; decoding emits the labels of arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.presplit import PieceEncoder, byte_letters, split_words

_FOREVER = 1 << 60
#: Bits of a token and of a spelling's number in the table's numbers, and the letter of a word's last byte beyond the byte.
_BITS, LAST = 21, 256
_LOW = (1 << _BITS) - 1


class TokenizationAutomaton:
    """Compiled from a vocabulary, its merges in order, and the mark of a word's end.

    The table is emptied down to the vocabulary's spellings beyond ``most_arcs``.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "", most_arcs: int = 200_000):
        self.end, self.most_arcs = end, most_arcs
        self.spelled: dict[int, tuple[int, ...]] = {}
        # the symbols at a token's ends, outermost last, each with the merge that took it in
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._with: dict[int, dict[int, int]] = {}  # second symbol -> first symbol -> merge
        self._next: dict[int, int] = {}  # spelling and letter -> spelling
        self._whole, self._longer = [0], [False]  # the token of each spelling (plus 1), and whether it goes on
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        for text in (c + e for c in letters for e in {"", end}):
            if text in vocab:
                self._symbol(vocab[text], text, byte_of, None, -1)
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b], a + b, byte_of)
        self.compile()

    def _symbol(self, token: int, text: str, byte_of: dict[str, int], halves: tuple[int, int] | None, born: int) -> None:
        last = bool(self.end) and text.endswith(self.end)
        spelling = [byte_of[c] for c in (text[: -len(self.end)] if last else text)]
        if last:
            spelling[-1] += LAST
        self.spelled[token] = tuple(spelling)
        self._left[token] = self._right[token] = [(token, _FOREVER)]
        if halves:
            u, v = halves
            self._left[token] = [(token, _FOREVER), (u, born), *self._left[u][1:]]
            self._right[token] = [(token, _FOREVER), (v, born), *self._right[v][1:]]
        at = 0
        for x in spelling:
            key = at << 9 | x
            if key not in self._next:
                self._next[key] = len(self._whole)
                self._whole.append(0)
                self._longer.append(False)
            self._longer[at] = True
            at = self._next[key]
        self._whole[at] = token + 1

    def _gadget(self, k: int, u: int, v: int, w: int, text: str, byte_of: dict[str, int]) -> None:
        """Applies one merge to the automaton of the merges before it."""
        if w in self.spelled:
            raise ValueError(f"two merges make {text!r}")
        if u not in self.spelled or v not in self.spelled:
            return
        alive = self._follows(u, v)
        self._with.setdefault(v, {})[u] = k
        if alive:
            self._symbol(w, text, byte_of, (u, v), k)

    def _follows(self, a: int, b: int) -> bool:
        """Whether no gadget so far took the way from a to b away."""
        for y, right in self._left[b]:
            firsts = self._with.get(y)
            if firsts:
                for x, left in self._right[a]:
                    k = firsts.get(x)
                    if k is not None and k < left and k <= right:
                        return False
        return True

    def compile(self) -> None:
        """The deterministic table along all spellings."""
        self.states: dict[tuple[int, ...], int] = {(0,): 0}
        self._open: list[tuple[int, ...]] = [(0,)]
        self.table: dict[int, int] = {}
        for spelling in self.spelled.values():
            state = 0
            for x in spelling:
                arc = self.table.get(state << 9 | x)
                if arc is None:
                    arc = self._arc(state, x)
                state = arc >> _BITS
        self._compiled = len(self.table), len(self._open)

    def _forget(self) -> None:
        """Takes away the arcs and states that were added since ``compile``."""
        arcs, states = self._compiled
        self.table, self.states = dict(islice(self.table.items(), arcs)), dict(islice(self.states.items(), states))
        del self._open[states:]

    def _arc(self, state: int, x: int) -> int:
        """Adds the arc of one letter; what is open is coded as (token before plus 1, spelling)."""
        label, still = 0, []
        for pair in self._open[state]:
            at = self._next.get((pair & _LOW) << 9 | x)
            if at is None:
                continue
            token = self._whole[at]
            if token and not label and (pair <= _LOW or self._follows((pair >> _BITS) - 1, token - 1)):
                label = token
            if self._longer[at]:
                still.append(pair & ~_LOW | at)
        if not label:
            raise ValueError(f"no token spells the letter {x}")
        still.append(label << _BITS)
        key = tuple(still) if x < LAST else ()  # a word's last letter leaves nothing open
        if key not in self.states:
            self.states[key] = len(self._open)
            self._open.append(key)
        arc = self.table[state << 9 | x] = self.states[key] << _BITS | label - 1
        return arc

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens on the one path that spells the word (not empty)."""
        if len(self.table) > self.most_arcs:
            self._forget()
        table, state, labels = self.table, 0, []
        letters = [*word[:-1], word[-1] + LAST] if self.end else word
        for x in letters:
            arc = table.get(state << 9 | x)
            if arc is None:
                arc = self._arc(state, x)
            labels.append(arc & _LOW)
            state = arc >> _BITS
        out, i = [], len(labels)
        while i:
            out.append(labels[i - 1])
            i -= len(self.spelled[labels[i - 1]])
        return out[::-1]


class WordTokenizer:
    """Encoder and decoder for one tokenizer file with the pre-split rule ``words``; made once a process."""

    _made: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenizationAutomaton(vocab, merges, model.get("end_of_word_suffix") or "")
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.path, self._library = path, None
        self.labels = [b""] * (max([*vocab.values(), *self.control.values()]) + 1)
        for text, i in [*vocab.items(), *self.control.items()]:
            self.labels[i] = text.encode()
        self.encoder = PieceEncoder(split_words, True, self._new, self._slow, [*self.control], most=150_000)

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _new(self, signs: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = signs.astype(np.uint32).tobytes().decode("utf-32-le")
        ids = [self.automaton.encode_word(text[a:z].encode()) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def _slow(self, text: str) -> np.ndarray:
        """Texts with rare signs or control strings: split by the library's rules, encoded by the automaton."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._byte = {c: b for b, c in enumerate(byte_letters())}
        out: list[int] = []
        at = 0
        for m in [*self.encoder.control.finditer(text), None]:
            plain = text[at : m.start()] if m else text[at:]
            for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(plain)) if plain else ():
                out += self.automaton.encode_word(bytes(self._byte[c] for c in piece))
            if m:
                out.append(self.control[m.group()])
                at = m.end()
        return np.array(out, np.int32)


def spelled(labels: list[bytes], ids: list[int]) -> str:
    """The labels of the arcs to these tokens, joined by a space."""
    return b" ".join([labels[i] for i in ids]).decode()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids_out: str = "ids", decoded_out: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, no special tokens added; null and empty give none.

    With ``decoded_out`` the ids are decoded again in the same pass, as by ``decode``.

    ``path`` is the tokenizer file, which each executor must have. Rows stay
    where they are, so hot keys and repeated rows need no care; other columns
    are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        for b in batches:
            for lo, ids, off in tokenizer.encoder.encode_column(b.column(1)):
                cols = [b.column(0).slice(lo, len(off) - 1), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded_out:
                    cols.append(pa.array([spelled(tokenizer.labels, ids[x:y].tolist()) for x, y in zip(off[:-1], off[1:])], pa.string()))
                yield pa.record_batch(cols, ["doc_id", ids_out, *([decoded_out] if decoded_out else [])])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, `{ids_out}` array<int>" + (f", `{decoded_out}` string" if decoded_out else ""))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_out: str = "decoded") -> DataFrame:
    """(doc_id, ids, decoded): the labels of the arcs, joined by a space, special tokens included.

    Null ids give null, an empty list gives the empty string. Rows stay where they
    are: repeated rows give repeated rows, an empty table gives no rows, and other
    columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = WordTokenizer.of(path).labels
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [None if ids is None else spelled(labels, ids) for ids in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", text_out])

    return df.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id long, ids array<int>, `{text_out}` string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _digests(df: DataFrame, path: str) -> DataFrame:
    back = encode(df, path, decoded_out="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded, as digests."""
    return _digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())


def tokens_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: (doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left.

    Null and empty texts have no tokens; repeated rows give repeated rows; an empty
    table gives no rows; all other columns go.
    """
    return _digests(docs, default_path())
