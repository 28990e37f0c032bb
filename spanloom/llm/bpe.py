"""Byte-pair encoding and decoding with an automaton over tokens.

``compile_merges`` takes the merges in rank order and adds a gadget for each: merging (u, v) into w at rank k

* cuts the arc v out of the state reached by u (from then on u may not be followed by v),
* gives w an arc wherever u had one at that time (what forbids u forbids w, if it was cut at rank k or before),
* leads w to a copy of v's state as it was before k (what may not follow v may not follow w, if cut before k).

So every token has one state, kept as the gadgets' cuts and a line of copies with their ranks. The automaton is deterministic
over tokens and accepts, for every string of bytes, exactly one tokenization, the one that the merges make. Its transition
table has an entry for a state and a token: the state that follows, or none. A dense table would have the square of 50,000
entries, so an entry is worked out from the gadgets when it is first read and stays in the table from then on.

Encoding a pre-split word runs the table from the start state: the longest token that the table allows is taken, and taken
back if nothing follows. A prefix has one tokenization, so a place that led nowhere is never tried again, and a word costs at
most its length in places. Decoding emits the arcs' labels.

Defined cases: a null or empty text has no tokens and decodes to the empty text; repeated rows are encoded each; special
tokens' strings inside a text are the special token, as the library has it by default; a text of any length is encoded whole,
in blocks of its own; ties don't arise; columns beside the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from spanloom.llm import pretokens
from spanloom.llm.common import documents, texts, typed
from spanloom.llm.token_counts import byte_chars

NEVER = 1 << 40
#: The start state, and what the table holds where there is no arc.
START, NONE = (1 << 31) - 1, -1
#: Distinct words and entries of the table that a task keeps between blocks.
REMEMBERED, ARCS = 300_000, 1_000_000


class Automaton:
    """Tokens, their labels (bytes) and the cuts that the gadgets made."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[bytes, int]) -> None:
        self.special = special
        self.id_of = vocabulary
        self.labels: dict[int, bytes] = {i: b for b, i in vocabulary.items()} | {i: b for b, i in special.items()}
        # ways[t]: the states that t's state was copied from, each with the rank before which its cuts count
        self.ways: dict[int, tuple[tuple[int, int], ...]] = {}
        # heads[t]: the tokens that t begins with, each with the last rank at which a cut of it forbids t
        self.heads: dict[int, tuple[tuple[int, int], ...]] = {}
        self.cuts: dict[tuple[int, int], int] = {}
        for b, i in vocabulary.items():
            if len(b) == 1:
                self.ways[i] = self.heads[i] = ((i, NEVER),)
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if w in self.ways:  # a second way to a token that exists: the first has the lower rank
                self.cuts.setdefault((u, v), rank)
                continue
            self.cuts[u, v] = rank
            self.heads[w] = (*((x, min(limit, rank)) for x, limit in self.heads[u]), (w, NEVER))
            self.ways[w] = ((w, NEVER), *((x, min(until, rank)) for x, until in self.ways[v]))
        self.tokens = {b: i for b, i in vocabulary.items() if i in self.ways}
        self.longest = max(map(len, self.tokens))
        self.size = {i: len(b) for b, i in self.tokens.items()}
        # table[state << 32 | token]: the state that the token leads to, or NONE; a token's state has its number
        self.table: dict[int, int] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def _arc(self, a: int, b: int) -> bool:
        """Whether token b has an arc from the state that token a leads to."""
        for s, until in self.ways[a]:
            for x, limit in self.heads[b]:
                rank = self.cuts.get((s, x))
                if rank is not None and rank < until and rank <= limit:
                    return False
        return True

    def step(self, state: int, token: int) -> int:
        """The table's entry: the state that token leads to from state (START or another token's), or NONE."""
        key = state << 32 | token
        to = self.table.get(key)
        if to is None:
            if len(self.table) > ARCS:
                self.table.clear()
            to = self.table[key] = token if state == START or self._arc(state, token) else NONE
        return to

    def run(self, word: bytes) -> tuple[int, ...]:
        """The arcs of the path that spells word."""
        n, tokens, path, at, state = len(word), self.tokens, [], 0, START
        most = min(n, self.longest)
        dead = bytearray(n + 1)
        while at < n:
            size = min(n - at, most)
            while True:
                while size:
                    if not dead[at + size]:
                        token = tokens.get(word[at : at + size])
                        if token is not None and self.step(state, token) >= 0:
                            break
                    size -= 1
                if size:
                    path.append(token)
                    state = token
                    at += size
                    break
                dead[at] = 1  # nothing follows: take the last token back and try shorter ones
                last = self.size[path.pop()]
                at -= last
                size = last - 1
                state = path[-1] if path else START
        return tuple(path)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token (or of a special token's string)."""
        ids = self.words.get(word)
        if ids is None:
            ids = (self.special[word],) if word in self.special else self.run(word)
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self.words[word] = ids
        return ids

    def decode(self, ids) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def compile_merges(path: str) -> Automaton:
    """The automaton of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    of_char = {c: b for b, c in enumerate(byte_chars())}
    raw = lambda s: bytes(of_char[c] for c in s)
    special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
    vocabulary = {raw(s): i for s, i in file["model"]["vocab"].items() if s.encode() not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
    return Automaton(vocabulary, [(raw(a), raw(b)) for a, b in merges], special)


def encode(text: str | None, automaton: Automaton) -> list[int]:
    """One text's ids."""
    (_, _, block), *_ = pretokens.blocks([text], spaced=True, special=tuple(s.decode() for s in automaton.special))
    return [i for c in block.codes for i in automaton.encode_word(block.distinct[c])]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and of the text that the ids decode to."""

    def run(batches):
        automaton = compile_merges(path)
        special = tuple(s.decode() for s in automaton.special)
        for batch in batches:
            for a, b, block in pretokens.blocks(batch.column("text").to_pylist(), spaced=True, special=special):
                encoded = [automaton.encode_word(w) for w in block.distinct]
                lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
                written = [",".join(map(str, ids)) for ids in encoded]
                spelled = [b"".join([automaton.labels[i] for i in ids]) for ids in encoded]
                tokens = pretokens.sums(lengths[block.codes], block.first)
                ids, decoded = [], []
                for x, y in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
                    codes = block.codes[x:y].tolist()
                    ids.append(hashlib.sha256(",".join([written[c] for c in codes]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([spelled[c] for c in codes]).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(tokens), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(run, typed(SCHEMA, plain))


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids: the general output, for callers that want the ids themselves."""

    def run(batches):
        automaton = compile_merges(path)
        special = tuple(s.decode() for s in automaton.special)
        for batch in batches:
            for a, b, block in pretokens.blocks(batch.column("text").to_pylist(), spaced=True, special=special):
                words = [automaton.encode_word(w) for w in block.distinct]
                ids = [[i for c in block.codes[x:y].tolist() for i in words[c]] for x, y in zip(block.first[:-1], block.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(run, typed("doc_id bigint, ids array<int>", plain))


def decoded(frame: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """frame with the text that its ids spell."""
    @pandas_udf("string")
    def spell(column: pd.Series) -> pd.Series:
        automaton = compile_merges(path)
        return column.map(lambda x: None if x is None else automaton.decode(x))

    return frame.withColumn(to, spell(F.col(ids)))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
