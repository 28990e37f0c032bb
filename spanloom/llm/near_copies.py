"""Near-duplicates by the general rule: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

This is the SimHash operator with five-word shingles, a check of every candidate on whole sets, and a second net for what lies
beyond its radius: at similarity 0.8 fingerprints of 64 bits differ in ten bits on average, where parts of the pigeonhole are too
short to tell texts apart. Links are closed transitively. Three steps, none of which compares all with all:

1. Texts with the same set of shingles are one set. Sets are candidates if simhash.links joins their fingerprints, by the
   generalised pigeonhole. Beside that each set gets BANDS * ROWS min-hashes; sets that agree on a whole band meet, and are
   candidates if their sketches (a byte of each min-hash) agree on LIKELY places. A pair at similarity 0.8 meets there with
   probability 1 - (1 - 0.8^4)^16 = 0.9998, more similar ones more surely.
2. The sets that candidates join are made again from the texts and dealt out by group, a large group by pairs of blocks,
   so that a task holds a bounded number of shingles and every pair of a group meets somewhere.
3. There the similarities are exact; only links of LEAST or more stay.

Defined cases: words as in simhash (ASCII white space apart, ASCII letters in lower case); a text of fewer than five words
is one shingle; texts without words, or null, are alike; repeated rows are one class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, own_ids, partitions, release, squeezed, texts
from spanloom.llm.components import components
from spanloom.llm.simhash import LOWER, WORD, links, majority, shingle_hashes

WIDTH = 5
#: Similarity of linked sets, in tenths.
LEAST = 8
BANDS, ROWS = 16, 4
#: Places of two sketches that agree, of 64; at similarity 0.8 fewer come about once in 100,000 pairs.
LIKELY = 36
#: Shingles of a block; a task compares two blocks at a time.
BLOCK = 1 << 20
#: Shingles whose min-hashes are made at a time.
CHUNK = 4096
#: Rows of bands that a task compares at a time.
BUCKET_ROWS = 200_000

_RNG = np.random.default_rng(20250805)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _hashes(text: str | None) -> np.ndarray:
    return shingle_hashes(WORD.findall((text or "").translate(LOWER)), WIDTH)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles, as ascending hashes."""
    return np.unique(_hashes(text))


def _min_hashes(found: np.ndarray) -> np.ndarray:
    least = np.full(len(_A), ~np.uint64(0))
    for k in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[k : k + CHUNK, None] * _A + _B).min(axis=0))
    return least


def _sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, the digest of its set, the number of shingles, the fingerprint, a hash of each band and the sketch."""

    def run(batches):
        for batch in batches:
            whole, sizes, bands, sketch, fps = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                every = _hashes(t)
                found = np.unique(every)
                fps.append(majority(every))
                least = _min_hashes(found)
                whole.append(xxhash.xxh128_digest(found.tobytes()))
                sizes.append(len(found))
                bands.append([xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in least.reshape(BANDS, ROWS)])
                sketch.append((least >> np.uint64(56) ^ least >> np.uint64(24)).astype(np.uint8).tobytes())
            columns = [batch.column("doc_id"), pa.array(whole, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "size", "bands", "sketch", "fp"])
        release()

    plain = texts(docs, doc_id, text)
    return plain.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, whole binary, size bigint, bands array<bigint>, sketch binary, fp bigint")


def _groups(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal keys, of two rows or more."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.append(np.flatnonzero(new), len(new))
    return [(s, e) for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if e - s > 1]


def _forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of what near(x, rest), a mask over rest, links among 0 to n - 1; as in simhash.forest."""
    out: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = near(x, rest)
            if hit.any():
                found = rest[hit].tolist()
                out += [(x, y) for y in found]
                front += found
                rest = rest[~hit]
    return out


def _link_table(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _likely(keyed: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) between sets (rows p, v, id, sketch) that share a band's hash v and have like sketches."""

    def run(table: pa.Table) -> pa.Table:
        p, v, ids = (table.column(c).to_numpy() for c in ("p", "v", "id"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.lexsort((ids, v, p))
        p, v, ids = p[order], v[order], ids[order]
        a, b = [], []
        for s, e in _groups(p, v):
            own = sketch[order[s:e]]
            for x, y in _forest(e - s, lambda x, rest, own=own: (own[rest] == own[x]).sum(axis=1) >= LIKELY):
                a.append(int(ids[s + x]))
                b.append(int(ids[s + y]))
        release()
        return _link_table(a, b)

    return keyed.withColumn("bucket", F.pmod(F.xxhash64("p", "v"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of LEAST tenths or more, exactly."""
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(len(names), bool)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rest), bool)
        fit = np.flatnonzero((10 * size[rest] >= LEAST * size[x]) & (10 * size[x] >= LEAST * size[rest]))
        if not len(fit):
            return out
        mine, n = flat[begin[x] : begin[x] + size[x]], size[rest[fit]]
        mark[mine] = True
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(begin[rest[fit]] - first, n)
        both = np.add.reduceat(mark[flat[at]].astype(np.int64), first)
        mark[mine] = False
        out[fit] = 10 * both >= LEAST * (size[x] + n - both)
        return out

    return _forest(len(sets), near)


def _verified(dealt: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) among the texts (rows g, i, j, id, data) that meet in g, i, j."""
    import zstandard

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        g, i, j, ids = (table.column(c).to_numpy() for c in ("g", "i", "j", "id"))
        order = np.lexsort((ids, j, i, g))
        data = table.column("data")
        a, b = [], []
        for s, e in _groups(g[order], i[order], j[order]):
            for x, y in similar([shingles(unpack(data[int(k)].as_py()).decode()) for k in order[s:e]]):
                a.append(int(ids[order[s + x]]))
                b.append(int(ids[order[s + y]]))
        release()
        return _link_table(a, b)

    return dealt.withColumn("bucket", F.pmod(F.xxhash64("g", "i", "j"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def _fingerprint_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets (id, fp) whose fingerprints are equal or linked, by way of each fingerprint's first set."""
    prints = checkpoint(sets.groupBy("fp").agg(F.min("id").alias("first")))
    equal = sets.join(prints, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = links(prints)
    ends = near.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """id: the smallest doc_id of each class of near-duplicates, of docs whose ids tell the rows apart."""
    prints = _sketches(docs, doc_id, text).groupBy("whole").agg(F.min_by(F.struct("size", "bands", "sketch", "fp"), "doc_id").alias("s"), F.min("doc_id").alias("id"))
    sets = checkpoint(prints.select("id", "s.*"))
    buckets = max(4 * partitions(docs.sparkSession), sets.count() * BANDS // BUCKET_ROWS) + 1
    likely = components(_fingerprint_links(sets).unionByName(_likely(sets.select("id", "sketch", F.posexplode("bands").alias("p", "v")), buckets)))
    groups = checkpoint(likely.join(sets.select("id", "size"), F.col("vertex") == F.col("id")).select("id", F.col("component").alias("g"), "size"))
    blocks = groups.groupBy("g").agg(F.ceil(F.sum("size") / block).cast("int").alias("m"))
    placed = groups.join(blocks, "g").withColumn("k", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    # every pair of blocks meets once; a group of one block is a pair by itself
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda x: (x != F.col("k")) | (F.col("m") == 1))
    source = squeezed(texts(docs, doc_id, text).select(F.col("doc_id").cast("bigint").alias("id"), "text"), "text", "data")
    near = source.join(placed, "id").select("id", "g", "data", F.explode(F.transform(others, lambda x: F.struct(F.least(x, "k").alias("i"), F.greatest(x, "k").alias("j")))).alias("at"))
    found = _verified(near.select("id", "g", "at.i", "at.j", "data"), buckets)
    joined = components(found).select(F.col("vertex").alias("id"), "component")
    return sets.select("id").join(joined, "id", "left").where("component is null or component = id").select("id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id, of repeated (or null, which come first) ids that with the least text."""
    rows, uid = own_ids(docs, doc_id, text)
    chosen = survivors(rows, uid, text).select(F.col("id").alias("_chosen")).hint("shuffle_hash")
    kept = rows.join(chosen, rows[uid] == chosen["_chosen"], "left_semi")
    return kept if uid == doc_id else kept.drop(uid)
