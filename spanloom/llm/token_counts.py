"""Token counts without ids: pieces per distinct pre-token, joined to per-document pre-token frequencies.

A block of documents becomes a table of distinct pre-tokens and a sparse one of frequencies (document, pre-token); the pieces of
each distinct pre-token are counted once, joined to the frequencies by its number, and summed per document. No list of ids exists at
any time. Counts are kept between a task's blocks, so a task counts a pre-token once for up to REMEMBERED of them. Blocks never
meet and nothing is shuffled: one table of counts for the whole corpus would need a shuffled row per document and distinct
pre-token (README has the figures).

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; a text of any length is counted whole, in a block
of its own; nothing depends on order, so there are no ties; columns beside the id and the text are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import pretokens
from spanloom.llm.common import documents, texts, typed

WORD_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Distinct pre-tokens that a task remembers between blocks.
REMEMBERED = 400_000


@functools.cache
def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class PieceCounter:
    """Pieces of pre-tokens by the merges of a tokenizers file."""

    def __init__(self, path: str, special: tuple[str, ...]) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = tokenizer.model, tokenizer.normalizer
        self.table = dict(enumerate(byte_chars()))
        self.known = {s.encode(): 1 for s in special}
        self.special = dict(self.known)

    def counts(self, distinct: list[bytes]) -> np.ndarray:
        known, out = self.known, np.empty(len(distinct), np.int64)
        if len(known) > REMEMBERED:
            known = self.known = dict(self.special)
        for k, word in enumerate(distinct):
            n = known.get(word)
            if n is None:
                n = known[word] = len(self.model.tokenize(word.decode("latin-1").translate(self.table)))
            out[k] = n
        return out


@functools.cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path, WORD_SPECIAL)


SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens for the lower-casing vocabulary with word ends at path."""

    def count(batches):
        counter = _counter(path)
        for batch in batches:
            values = batch.column("text").to_pylist()
            for a, b, block in pretokens.blocks(values, spaced=False, special=WORD_SPECIAL, library=counter.normalizer):
                pieces = counter.counts(block.distinct)
                tokens = pretokens.sums(pieces[block.codes], block.first)
                size = [len(t.encode()) for t in values[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(count, typed(SCHEMA, plain))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
