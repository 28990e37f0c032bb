"""Removal of repeated byte strings by a difference-cover suffix sort, dealt out by content.

A byte goes if some string of WINDOW bytes that covers it also starts earlier (smaller document, or the same document
and an earlier start). What goes is decided by comparing bytes in sorted order, never by a digest:

1. Blocks. Texts are dealt into blocks of bounded size by id and kept there, compressed, in a checkpoint.
2. Strings without a partner are set aside. Every string belongs to the run of neighbouring strings that share their least
   GRAM-byte hash, its anchor, at the same place. Equal strings have equal anchors, so a block names the anchors it holds
   (eight bytes each), and hears which of them occur elsewhere or twice. The others' strings are nowhere else.
3. The rest travels with its bytes, dealt out by anchor. Equal runs of a block are merged first, bytes compared, so copies
   never pile up. An anchor with more than HOT runs is dealt out further by all bytes of each string, so no group is unbounded.
4. There equal runs are merged again, and the strings of the runs that differ are sorted by the difference-cover algorithm:
   triples at the positions 1 and 2 modulo 3 are sorted and named, the names' suffixes are sorted by recursion (never deeper
   than WINDOW bytes), the other suffixes are merged in, and adjacent prefixes are compared. In a stretch of equal prefixes
   all but the earliest occurrence are repeats.
5. The repeats' ranges return to the texts' blocks.

Digests only choose where strings meet and which runs are worth comparing; a collision costs a comparison, no byte.

Defined cases: a null text is empty; texts shorter than WINDOW lose nothing; repeated document ids (or null ones) are told
apart by their text, equal rows by an arbitrary order, so that all but one of them are later copies; an empty table gives an
empty result; other columns, however named, are kept; a text of any length is cut into segments, and its strings with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import checkpoint, checkpoint_dealt, documents, own_ids, partitions, release, squeezed

WINDOW = 100
GRAM = 24
#: Bytes that are hashed at a time; blocks are cut into segments that overlap by WINDOW - 1.
SEGMENT = 1 << 18
#: Bytes of texts in a block at most (a longer text is in a block with others all the same), and at least, as long as there are four
#: blocks to a partition: blocks talk to buckets, so needlessly many would make very many short messages.
BLOCK_BYTES, LEAST_BYTES = 1 << 25, 1 << 21
#: Bytes of runs that are sorted at a time, unless one anchor has more.
SORTED = 400_000
#: Different runs of one anchor that may meet in one group.
HOT = 4096

_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
REPLY = np.dtype([("h", "<u8"), ("n", "<u4")])
RANGE = np.dtype([("d", "<i8"), ("s", "<u4"), ("e", "<u4")])
PIECE = np.dtype([("d", "<i8"), ("s", "<u4"), ("m", "u1"), ("k", "<u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    """pmod(xxhash64(doc), blocks) as Spark has it for a long."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    x = rot(doc.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(42 + 8))
    x = rot(x, 27) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return (x ^ (x >> np.uint64(32))).view(np.int64) % blocks


class Powers:
    """Powers of the hash's base and of its inverse, up to a segment's length."""

    def __init__(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up, self.down = (self._powers(b, n) for b in (_BASE, inverse))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            step = min(k, n - k)
            out[k : k + step] = out[:step] * np.uint64(pow(base, k, 1 << 64))
            k += step
        return out


class Digests:
    """Digests of any stretches of some bytes."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        n = len(data)
        self.down, self.total = powers.down, np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * powers.up[:n], out=self.total[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.total[b] - self.total[a]) * self.down[a])


def runs(data: np.ndarray, room: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one segment's bytes: the runs' starts, numbers of strings and anchors' hashes; a string starts where room (the
    bytes left of the text) is WINDOW or more."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    digest = Digests(data, powers)
    at = np.arange(n - GRAM + 1)
    grams = digest(at, at + GRAM)
    low = np.uint64(SEGMENT * 2 - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[span - width : span - width + n - WINDOW + 1])
    valid = room[: n - WINDOW + 1] >= WINDOW
    anchor = np.where(valid, (least & low).astype(np.int64), -1)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, len(anchor)))
    used = anchor[start] >= 0
    start, count = start[used], count[used]
    return start, count, grams[anchor[start]]


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (d, s, e) as maximal ones."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges["s"], ranges["d"]))]
    doc, start, end = ranges["d"], ranges["s"].astype(np.int64), ranges["e"].astype(np.int64)
    # ends only grow within a document once each document is set on a stretch of its own
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 33
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]))
    out = np.empty(len(new), RANGE)
    last = np.append(new[1:], len(ranges)) - 1
    out["d"], out["s"], out["e"] = doc[new], start[new], reach[last] - shift[last]
    return out


def _by_bucket(rows: np.ndarray, key: np.ndarray):
    """(key, rows as bytes) for each key."""
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    for a, b in zip(first, np.append(first, len(key))[1:], strict=True):
        yield int(key[a]), rows[a:b].tobytes()


MESSAGES = "kind int, bucket int, source int, payload binary"
ANCHORS, REPLIES, RANGES, PIECES = range(4)


def _frame(rows: list[tuple]) -> pa.Table:
    kinds, buckets, sources, payloads = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "source": pa.array(sources, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _read(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(source, payload) of the messages of a kind."""
    return [(s, p) for k, s, p in zip(*(table.column(c).to_pylist() for c in ("kind", "source", "payload")), strict=True) if k == kind]


def _as(dtype, found: list[tuple[int, bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join([p for _, p in found]), dtype)


def _cut(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    after = np.cumsum(size)
    return data[np.repeat(at - (after - size), size) + np.arange(int(size.sum()))]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number (of no copy)."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes at a and at b are the same; size is 8 or more."""
    out = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        step = np.minimum(k, size - 8)
        out &= words[a + step] == words[b + step]
    return out


def _chunks(size: np.ndarray):
    """(from, to) of stretches of SEGMENT bytes in all, or of one item."""
    begin, total = 0, np.cumsum(size)
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SEGMENT, side="right")))
        yield begin, end
        begin = end


def digests(data: np.ndarray, at: np.ndarray, size: np.ndarray, powers: Powers) -> np.ndarray:
    """Digests of the size bytes at each place."""
    out = np.empty(len(at), np.uint64)
    for a, b in _chunks(size):
        n = size[a:b]
        end = np.cumsum(n)
        out[a:b] = Digests(_cut(data, at[a:b], n), powers)(end - n, end)
    return out


def equal_runs(words: np.ndarray, h: np.ndarray, m: np.ndarray, digest: np.ndarray, at: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs, and which of them (in that order) have the same bytes as the one before, which is earlier."""
    order = np.lexsort((when, digest, m, h))
    h, m, digest, at = h[order], m[order], digest[order], at[order]
    same = np.zeros(len(order), bool)
    which = np.flatnonzero((h[1:] == h[:-1]) & (m[1:] == m[:-1]) & (digest[1:] == digest[:-1])) + 1
    same[which] = _same(words, at[which - 1], at[which], m[which].astype(np.int64) + WINDOW - 1)
    return order, same


class Block:
    """A block's texts end to end, in the order of their ids."""

    def __init__(self, table: pa.Table) -> None:
        docs = table.column("uid").to_numpy()
        order = np.argsort(docs, kind="stable")
        unpack = zstandard.ZstdDecompressor().decompress
        parts = table.column("data").take(pa.array(order)).to_pylist()
        data = [unpack(x) for x in parts]
        self.docs = docs[order]
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def runs(self, powers: Powers, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, numbers of strings, anchors' hashes and digests of the runs, of the anchors wanted (ascending) alone."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for low in range(0, max(len(self.data) - WINDOW + 1, 0), SEGMENT):
            data = self.data[low : low + SEGMENT + WINDOW - 1]
            first, last = np.searchsorted(self.end, [low, low + len(data) - 1], side="right")
            ends = self.end[first : last + 1] - low
            room = np.repeat(ends, np.diff(np.minimum(ends, len(data)), prepend=0)) - np.arange(len(data))
            start, count, h = runs(data, room, powers)
            if wanted is not None:
                near = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                hit = wanted[near] == h if len(wanted) else np.zeros(len(h), bool)
                start, count, h = start[hit], count[hit], h[hit]
            out.append((start + low, count, h, Digests(data, powers)(start, start + count + WINDOW - 1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents and the offsets of places."""
        owner = np.searchsorted(self.end, at, side="right")
        return self.docs[owner], at - self.begin[owner]

    def ranges(self, at: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), RANGE)
        out["d"], out["s"] = self.places(at)
        out["e"] = out["s"] + m.astype(np.uint32) + np.uint32(WINDOW - 1)
        return merged(out)


def _powers() -> Powers:
    return Powers(SEGMENT + 2 * WINDOW)


def _name_anchors(blocks: int):
    """Per block: its anchors. Those of one run by themselves, the others with the number of their different runs."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        _, m, h, digest = Block(texts).runs(_powers())
        order = np.lexsort((digest, m, h))
        h, m, digest = h[order], m[order], digest[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        unlike = new.copy()
        unlike[1:] |= (m[1:] != m[:-1]) | (digest[1:] != digest[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(h)))
        out = np.empty(len(first), REPLY)
        out["h"] = h[first]
        out["n"] = np.where(count == 1, 0, np.add.reduceat(unlike, first) if len(first) else 0)
        bucket = (out["h"] % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out, bucket = out[order], bucket[order]
        at = np.searchsorted(bucket, np.arange(blocks + 1))
        rows = []
        for k in np.flatnonzero(np.diff(at)).tolist():
            mine = out[at[k] : at[k + 1]]
            once = mine["h"][mine["n"] == 0]
            rows.append((ANCHORS, k, key[0].as_py(), np.int64(len(once)).tobytes() + once.tobytes() + mine[mine["n"] > 0].tobytes()))
        release()
        return _frame(rows)

    return run


def _meet_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per bucket of anchors: to each block, those of its anchors that have two runs or more, and the number of different ones."""
    hs, ns, sources = [], [], []
    for source, payload in _read(table, ANCHORS):
        n = int(np.frombuffer(payload[:8], np.int64)[0])
        several = np.frombuffer(payload[8 + 8 * n :], REPLY)
        hs += [np.frombuffer(payload[8 : 8 + 8 * n], np.uint64), several["h"]]
        ns += [np.zeros(n, np.uint32), several["n"]]
        sources.append(np.full(n + len(several), source, np.int32))
    if not hs:
        return _frame([])
    h, n, source = np.concatenate(hs), np.concatenate(ns), np.concatenate(sources)
    order = np.argsort(h, kind="stable")
    h, n, source = h[order], n[order], source[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    size = np.diff(np.append(first, len(h)))
    shared = np.repeat((size > 1) | (n[first] > 0), size)
    out = np.empty(int(shared.sum()), REPLY)
    out["h"] = h[shared]
    out["n"] = np.minimum(np.repeat(np.add.reduceat(np.maximum(n, 1).astype(np.int64), first), size)[shared], 2**32 - 1)
    return _frame([(REPLIES, k, 0, p) for k, p in _by_bucket(out, source[shared].astype(np.int64))])


def _send_pieces(buckets: int, hot: int):
    """Per block: the bytes of the runs whose anchors are shared, to the anchors' buckets; equal runs go once."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
        told = _as(REPLY, _read(replies, REPLIES))
        if not len(told) or not texts.num_rows:
            return _frame([])
        told = told[np.argsort(told["h"])]
        powers, block = _powers(), Block(texts)
        at, m, h, digest = block.runs(powers, told["h"])
        words = _words(block.data)
        order, same = equal_runs(words, h, m, digest, at, at)
        ranges = [block.ranges(at[order[same]], m[order[same]])]
        order = order[~same]
        at, m, h = at[order], m[order], h[order]
        n = told["n"][np.searchsorted(told["h"], h)].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        here = np.diff(np.append(first, len(h)))
        alone = (n == 1) & (np.repeat(here, here) == 1)  # all its runs were in this block, and equal
        many = (n > hot) & ~alone
        if many.any():  # each string by itself, dealt by all its bytes
            inner = np.arange(int(m[many].sum())) - np.repeat(np.cumsum(m[many]) - m[many], m[many])
            where = np.repeat(at[many], m[many]) + inner
            ways = np.repeat(n[many] * (WINDOW - GRAM) // hot + 1, m[many]).astype(np.uint64)
            whole = digests(block.data, where, np.full(len(where), WINDOW), powers)
            dealt = _mix(np.repeat(h[many], m[many]) + whole % ways)
            one = np.ones(len(where), np.int64)
            order, same = equal_runs(words, dealt, one, whole, where, where)
            ranges.append(block.ranges(where[order[same]], one[order[same]]))
            order = order[~same]
            rest = ~many & ~alone
            at, m, h = np.concatenate([at[rest], where[order]]), np.concatenate([m[rest], one[order]]), np.concatenate([h[rest], dealt[order]])
        else:
            at, m, h = at[~alone], m[~alone], h[~alone]
        mixed = _mix(h)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, m, bucket, mixed = at[order], m[order], bucket[order], mixed[order]
        pieces = np.empty(len(at), PIECE)
        pieces["d"], pieces["s"] = block.places(at)
        pieces["m"], pieces["k"] = m, mixed >> np.uint64(32)
        pack = zstandard.ZstdCompressor(level=1).compress
        own = merged(np.concatenate(ranges))
        rows = [(RANGES, key[0].as_py() % buckets, key[0].as_py(), own.tobytes())] if len(own) else []
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[k], bounds[k + 1]
            rows.append((PIECES, k, 0, pack(np.int64(b - a).tobytes() + pieces[a:b].tobytes() + _cut(block.data, at[a:b], m[a:b] + WINDOW - 1).tobytes())))
        del block, words
        release()
        return _frame(rows)

    return run


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of tuples of numbers."""
    name = columns[0].astype(np.int64)
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if (int(name.max(initial=0)) + 1) * width >= 1 << 62:
            name = np.unique(name, return_inverse=True)[1]
        name = name * width + column
    return np.unique(name, return_inverse=True)[1] + 1


def suffix_order(text: np.ndarray, cover: int = 1, need: int = WINDOW) -> np.ndarray:
    """Positions of text (numbers from 1, of cover bytes each) in the order of their suffixes, as far as need bytes tell."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = np.concatenate([text, np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with a place after the end, so that the two halves stay apart
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    name = _names(t[sample], t[sample + 1], t[sample + 2])
    rank = np.zeros(n + 3, np.int64)
    if cover * 3 >= need or int(name.max(initial=0)) == len(sample):
        order = np.argsort(name, kind="stable")
        rank[sample] = name
    else:
        order = suffix_order(name, cover * 3, need)
        rank[sample[order]] = np.arange(1, len(sample) + 1)
    order = sample[order]
    order = order[order < n]
    zeros = np.arange(0, n, 3)
    wide = int(rank.max(initial=0)) + 1
    pair = t[:-1] * wide + rank[1:]
    zeros = zeros[np.argsort(pair[zeros], kind="stable")]
    if int(t.max(initial=0) + 1) ** 2 * wide < 1 << 62:
        triple = (t[:-2] * (int(t.max(initial=0)) + 1) + t[1:-1]) * wide + rank[2:]
    else:
        triple = (np.unique(t[:-2] * (int(t.max(initial=0)) + 1) + t[1:-1], return_inverse=True)[1]) * wide + rank[2:]
    before = np.empty(len(order), np.int64)
    one = order % 3 == 1
    before[one] = np.searchsorted(pair[zeros], pair[order[one]])
    before[~one] = np.searchsorted(np.sort(triple[zeros]), triple[order[~one]])
    place = np.arange(len(order)) + np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = order
    out[free] = zeros
    return out


def repeated(data: np.ndarray, pieces: np.ndarray, when: np.ndarray) -> np.ndarray:
    """Ranges of the strings in pieces (laid end to end in data; when: their order) that also start earlier."""
    size = pieces["m"].astype(np.int64) + WINDOW - 1
    begin = np.cumsum(size) - size
    order = suffix_order(data.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(pieces)), size)[order]
    inner = order - begin[owner]
    valid = inner < pieces["m"][owner]
    order, owner, inner = order[valid], owner[valid], inner[valid]
    if not len(order):
        return np.zeros(0, RANGE)
    same = _same(_words(data), order[:-1], order[1:], np.full(len(order) - 1, WINDOW))
    place = when[owner] * 256 + inner  # strings of a piece are neighbours, pieces of a document never share a string
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    later = place > np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(order))))
    out = np.empty(int(later.sum()), RANGE)
    out["d"], out["s"] = pieces["d"][owner[later]], pieces["s"][owner[later]] + inner[later]
    out["e"] = out["s"] + np.uint32(WINDOW)
    return merged(out)


def repeats(data: np.ndarray, pieces: np.ndarray, powers: Powers) -> np.ndarray:
    """Ranges of the strings in pieces, of any anchors, that also start earlier: equal runs first, then the strings of the others."""
    size = pieces["m"].astype(np.int64) + WINDOW - 1
    begin = np.cumsum(size) - size
    when = np.empty(len(pieces), np.int64)
    when[np.lexsort((pieces["s"], pieces["d"]))] = np.arange(len(pieces))
    order, same = equal_runs(_words(data), pieces["k"], pieces["m"], digests(data, begin, size, powers), begin, when)
    copies = pieces[order[same]]
    found = np.empty(len(copies), RANGE)
    found["d"], found["s"], found["e"] = copies["d"], copies["s"], copies["s"] + copies["m"] + np.uint32(WINDOW - 1)
    out = [found]
    order = order[~same]
    key = pieces["k"][order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    count = np.diff(np.append(first, len(key)))
    several = np.repeat(count > 1, count)
    order, key = order[several], key[several]
    # whole anchors, SORTED bytes at a time
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    total = np.concatenate([[0], np.cumsum(size[order])])
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total[starts], total[starts[a]] + SORTED, side="right")) - 1)
        mine = order[starts[a] : starts[b] if b < len(starts) else len(order)]
        out.append(repeated(_cut(data, begin[mine], size[mine]), pieces[mine], when[mine]))
        a = b
    return merged(np.concatenate(out))


def _sort_strings(blocks: int):
    """Per bucket of anchors: the repeats' ranges, back to the texts' blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        heads, bodies = [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for _, packed in _read(table, PIECES):
            payload = unpack(packed)
            n = int(np.frombuffer(payload[:8], np.int64)[0])
            heads.append(np.frombuffer(payload[8 : 8 + n * PIECE.itemsize], PIECE))
            bodies.append(payload[8 + n * PIECE.itemsize :])
        rows = [(RANGES, s, 0, p) for s, p in _read(table, RANGES)]  # found in a block already
        if heads:
            found = repeats(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(heads), _powers())
            rows += [(RANGES, k, 0, p) for k, p in _by_bucket(found, block_of(found["d"], blocks))]
        release()
        return _frame(rows)

    return run


def _whole(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a range that holds whole characters only."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _remove(names: list[str], keep_text: bool):
    """Per block of documents: what is left of each text."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, messages: pa.Table) -> pa.Table:
        ranges = merged(_as(RANGE, _read(messages, RANGES)))
        docs = texts.column("uid").to_numpy()
        a, b = (np.searchsorted(ranges["d"], docs, side=s) for s in ("left", "right"))
        starts, ends = ranges["s"].tolist(), ranges["e"].tolist()
        size, gone, spans, sha, left = [], [], [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for k, x in enumerate(texts.column("data").to_pylist()):
            data, at, kept, whole, n = unpack(x), 0, [], [], 0
            for s, e in zip(starts[a[k] : b[k]], ends[a[k] : b[k]], strict=True):
                kept.append(data[at:s])
                n += e - s
                if keep_text:
                    whole.append(_whole(data, s, e))
                at = e
            kept.append(data[at:])
            size.append(len(data))
            gone.append(n)
            spans.append(int(b[k] - a[k]))
            sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
            if keep_text:
                at, parts = 0, []
                for s, e in whole:
                    parts.append(data[at:s])
                    at = e
                left.append((b"".join(parts) + data[at:]).decode())
        out = {c: texts.column(c) for c in names}
        out |= {"_n_bytes": pa.array(size, pa.int64()), "_n_removed": pa.array(gone, pa.int64()), "_n_spans": pa.array(spans, pa.int64()), "_sha": pa.array(sha, pa.string())}
        if keep_text:
            out["_left"] = pa.array(left, pa.string())
        return pa.table(out)

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per row: row (the columns of docs, as a struct), n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes and,
    if keep_text, the text without the whole characters that were removed, in row."""
    spark = docs.sparkSession
    rows, uid = own_ids(docs, doc_id, text)
    total = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    n = max(total // BLOCK_BYTES, min(4 * partitions(spark), total // least_bytes)) + 1
    names = [f"c{k}" for k, c in enumerate(docs.columns) if c != text]
    others = [rows[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text]
    flat = rows.select(rows[uid].cast("bigint").alias("uid"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"), *others)
    dealt = squeezed(flat.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")), "text", "data")
    texts = checkpoint_dealt(dealt, "block")

    plain = texts.select("uid", "data", "block")
    anchors = plain.groupBy("block").applyInArrow(_name_anchors(n), MESSAGES)
    replies = checkpoint(anchors.groupBy("bucket").applyInArrow(_meet_anchors, MESSAGES))
    pieces = plain.groupBy("block").cogroup(replies.groupBy("bucket")).applyInArrow(_send_pieces(n, hot), MESSAGES)
    ranges = checkpoint(pieces.groupBy("bucket").applyInArrow(_sort_strings(n), MESSAGES))
    schema = T.StructType([*[T.StructField(c, flat.schema[c].dataType) for c in names], *[T.StructField(c, T.LongType()) for c in ("_n_bytes", "_n_removed", "_n_spans")], T.StructField("_sha", T.StringType()), *[T.StructField("_left", T.StringType())] * keep_text])
    done = texts.groupBy("block").cogroup(ranges.groupBy("bucket")).applyInArrow(_remove(names, keep_text), schema)
    back = dict(zip([c for c in docs.columns if c != text], names, strict=True))
    fields = [F.col(back[c]).alias(c) if c in back else F.col("_left").alias(c) for c in docs.columns if c in back or keep_text]
    return done.select(F.struct(*fields).alias("row"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_sha").alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
