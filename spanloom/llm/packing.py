"""Packing by minimum bin slack.

Each document's ids (and an end id) fill whole windows first; the remainders form a multiset of lengths. For each
window the longest remainder is set, and subset-sum dynamic programming over a bitset finds the multiset of the
other lengths that comes closest to the capacity; backtracking through the bitsets gives its counts. A pattern is
used again as long as the counts last. When the closest sum leaves slack, the next remainder is cut to fill it, as
cuts are free; the very last tokens of a group go to sequences whose lengths are powers of two, which need no padding.

A task packs groups of GROUP_TOKENS ids, so its memory is bounded, and groups never meet: nothing is shuffled, and
no key can gather rows. sequence_id holds the task's partition in its upper bits.

Ids come from the merges' ranks; a file whose ids don't follow its merges is refused.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a text of any length is cut into as many
windows as it fills; of equal remainders the last read is taken first; columns beside the id and the text are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import pretokens
from spanloom.llm.common import documents, release, texts, typed
from spanloom.llm.token_counts import byte_chars

CAPACITY = 2048
END_ID = 1
#: Ids that a task holds at a time (beside the rest of a document or block).
GROUP_TOKENS = 4_000_000
REMEMBERED = 400_000


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """Of the multiset counts (length: how many), a part whose sum is as close to target as can be, not above it."""
    bits, seen, goal = 1, [], 1 << target
    full = (goal << 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= target), reverse=True):
        for _ in range(min(counts[length], target // length)):
            wider = (bits | bits << length) & full
            if wider == bits:
                break
            seen.append((length, bits))
            bits = wider
        if bits & goal:
            break
    at, used = bits.bit_length() - 1, defaultdict(int)
    for length, before in reversed(seen):
        if not before >> at & 1:
            used[length] += 1
            at -= length
    return dict(used)


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold items of these lengths, each cut at will.

    Every sequence is as long as capacity or a power of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    items: dict[int, list[int]] = defaultdict(list)
    offset = [0] * len(lengths)
    for k, n in enumerate(lengths):
        for s in range(0, n - capacity + 1, capacity):
            out.append([(k, s, capacity)])
        offset[k] = n // capacity * capacity
        if n > offset[k]:
            items[n - offset[k]].append(k)
    counts = {length: len(ks) for length, ks in items.items()}

    def take(length: int) -> tuple[int, int, int]:
        k = items[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return k, offset[k], length

    left = sum(n * length for length, n in counts.items())
    while left >= capacity:
        longest = max(counts)
        counts[longest] -= 1
        used = fill(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        slack = capacity - sum(n * length for length, n in used.items())
        for _ in range(1 if slack else min(counts[length] // n for length, n in used.items())):
            row = [take(length) for length, n in used.items() for _ in range(n)]
            if slack:  # every other remainder is longer than the slack: cut one
                k, start, length = take(min(counts))
                row.append((k, start, slack))
                offset[k] += slack
                items[length - slack].append(k)
                counts[length - slack] = counts.get(length - slack, 0) + 1
            out.append(row)
            left -= capacity
    rest = [take(length) for length in sorted(counts, reverse=True) for _ in range(counts[length])]
    power = 1
    while power * 2 <= left:
        power *= 2
    while rest:
        row, room = [], power
        while room and rest:
            k, start, length = rest.pop()
            row.append((k, start, min(room, length)))
            if length > room:
                rest.append((k, start + room, length - room))
            room -= min(room, length)
        out.append(row)
        left -= power
        while power > max(left, 1):
            power //= 2
    return out


class Ids:
    """Ids of distinct pre-tokens, laid end to end, from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        of_char = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        # ids follow the merges' order, so they are the ranks
        merges = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in file["model"]["merges"]]
        found = [file["model"]["vocab"][m] for m in merges]
        if sorted(set(found)) != list(dict.fromkeys(found)):
            raise ValueError(f"{path}: ids don't follow the merges")
        ranks = {bytes(of_char[c] for c in s): i for s, i in file["model"]["vocab"].items() if s not in self.special}
        self.core = tiktoken.Encoding("ids", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[bytes, list[int]] = {}

    def of_block(self, block: pretokens.Block, end: int) -> list[np.ndarray]:
        """The ids of each of a block's documents, followed by end."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, encode, words = self.known, self.core.encode_single_piece, []
        for w in block.distinct:
            ids = known.get(w)
            if ids is None:
                text = w.decode()
                ids = known[w] = [self.special[text]] if text in self.special else encode(w)
            words.append(ids)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((i for ids in words for i in ids), np.uint32, int(sizes.sum()))
        n = sizes[block.codes]
        after = np.cumsum(n)
        ids = flat[np.arange(int(n.sum())) + np.repeat((np.cumsum(sizes) - sizes)[block.codes] - (after - n), n)]
        ends = np.concatenate([[0], after])[block.first]
        tail = np.array([end], np.uint32)
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def _ids(path: str) -> Ids:
    return Ids(path)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pieces(doc_ids: list, kind: pa.DataType, ids: list[np.ndarray], first_sequence: int) -> tuple[pa.RecordBatch, int]:
    rows, sequence = [], first_sequence
    for row in windows([len(x) for x in ids]):
        offset = 0
        for k, start, length in row:
            rows.append((doc_ids[k], start, length, zlib.crc32(ids[k][start : start + length].tobytes()), len(ids[k]), sequence, offset))
            offset += length
        sequence += 1
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else kind) for k, c in enumerate(zip(*rows, strict=True))], names), sequence


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END_ID) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence."""

    def run(batches):
        encoder = _ids(path)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, ids, held = [], [], 0
        for batch in batches:
            keys, kind = batch.column("doc_id").to_pylist(), batch.column("doc_id").type
            for a, b, block in pretokens.blocks(batch.column("text").to_pylist(), spaced=True, special=tuple(encoder.special)):
                found = encoder.of_block(block, end)
                doc_ids += keys[a:b]
                ids += found
                held += sum(map(len, found))
                if held >= GROUP_TOKENS:
                    out, sequence = _pieces(doc_ids, kind, ids, sequence)
                    yield out
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield _pieces(doc_ids, kind, ids, sequence)[0]
        encoder.known = {}  # the worker may idle beside others for a while
        del doc_ids, ids
        release()

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(run, typed(SCHEMA, plain))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
