"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at 3 or fewer differing bits. Bits that agree more often than chance are grouped, and
the groups are dealt into parts so that correlated bits share a part. A dynamic programme gives each part a
threshold t_i >= -1 with sum(t_i) = 3 - m + 1 (then two linked fingerprints agree to within t_i bits on some part i),
by the candidates that each choice would make; these are estimated from every distinct fingerprint. Fingerprints are
probed by part values (all values within t_i on one side) and verified on 64 bits.

Probing works on distinct fingerprints, grouped by part value; a task sees a bounded group, since a value that more
than HOT fingerprints share is dealt out again by the other bits, which must agree in the same way. A group's links are
reduced to a spanning forest on the spot, so that the output never holds all pairs of a group.

Defined cases: a null text, or one without words, has fingerprint zero and links like any other; equal texts have
equal fingerprints; repeated rows are one class; a bit set in exactly half of the shingles is 0; a text of any length is
hashed whole; columns beside the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, documents, own_ids, partitions, texts, typed
from spanloom.llm.components import components

DISTANCE = 3
SEED = 42
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Fingerprints that share a part value and may meet in one group.
HOT = 8192
#: Candidates that cost as much to verify as a probe row costs to move.
CANDIDATES = 200
#: Shingles whose bits are counted at a time.
CHUNK = 65536
#: Parts that a plan may have (one more than DISTANCE leaves a part unprobed), and bits that may differ in a probed part.
MOST_PARTS, MOST_BITS = 5, 2
#: Rows that a task compares at a time.
BUCKET_ROWS = 1_000_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text's word shingles (majority of the bits of their XXH64)."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    return majority(shingle_hashes(words, width))


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included; fewer words than width are one shingle."""
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(h), np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(h[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, a long with the fingerprint's bits."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(run, typed("doc_id bigint, fp bigint", plain))


def order_bits(distinct: DataFrame) -> list[int]:
    """The bits, correlated ones side by side: a chain that goes on with the bit most like the last one.

    From all distinct fingerprints: 64 * 64 sums, gathered per task in numpy and added up.
    """

    def run(batches):
        both = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32) * 2 - 1
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(both.ravel())], ["cell", "s"])

    sums = distinct.select("fp").mapInArrow(run, "cell int, s bigint").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    like = np.zeros(4096, np.int64)
    for r in sums:
        like[r["cell"]] = abs(r["s"])
    like = like.reshape(64, 64)
    chain, rest = [0], set(range(1, 64))
    while rest:
        chain.append(max(sorted(rest), key=lambda k: like[chain[-1], k]))
        rest.remove(chain[-1])
    return chain


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (-1 or more) that sum to total at the least cost; costs[i][t + 1] is part i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for k, more in enumerate(part):
                t = s + k - 1
                if t not in step or cost + more < step[t][0]:
                    step[t] = (cost + more, [*chosen, k - 1])
        best = step
    return best[total][1]


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """Some bits of fingerprints (longs), packed in the order named."""
    fps, out = fps.view(np.uint64), np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def _keyed(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """A row (p, v, fp) for each part p of each fingerprint and each value v within the part's threshold."""
    masks = [np.array(_neighbours(len(bits), t), np.int64) for bits, t in parts]

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for p, (bits, _) in enumerate(parts):
                own = _value(fps, bits)
                for mask in masks[p]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), p, np.int32)), pa.array(own ^ mask), pa.array(fps)], ["p", "v", "fp"])

    return distinct.select("fp").mapInArrow(run, "p int, v bigint, fp bigint")


def _neighbours(n: int, within: int) -> list[int]:
    """Masks of n bits with at most so many set."""
    return [sum(1 << b for b in c) for r in range(within + 1) for c in itertools.combinations(range(n), r)]


def plan(distinct: DataFrame) -> list[tuple[list[int], int]]:
    """Parts (bits, threshold) to probe, chosen over 2 to MOST_PARTS parts and thresholds up to MOST_BITS by estimated rows and candidates.

    The candidates of a part at threshold t are estimated from the collisions of its values, over all distinct
    fingerprints: pairs on the same value, times the values within t.
    """
    chain = order_bits(distinct)
    choices = {m: [chain[64 * i // m : 64 * (i + 1) // m] for i in range(m)] for m in range(2, MOST_PARTS + 1)}
    flat = [(m, i, bits) for m, parts in choices.items() for i, bits in enumerate(parts)]
    keyed = _keyed(distinct, [(bits, 0) for _, _, bits in flat]).withColumnRenamed("p", "k")
    counts = keyed.groupBy("k", "v").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    found = {r["k"]: (r["n"], r["pairs"]) for r in counts}
    best = (float("inf"), [])
    for m, parts in choices.items():
        costs = []
        for k, (_, _, bits) in enumerate(flat):
            if flat[k][0] == m:
                n, pairs = found.get(k, (0, 0.0))
                row = [0.0]
                for t in range(MOST_BITS + 1):
                    probes = len(_neighbours(len(bits), t))
                    row.append(n * probes + pairs * probes / CANDIDATES)
                costs.append(row)
        chosen = allocate(costs, DISTANCE - m + 1)
        cost = sum(row[t + 1] for row, t in zip(costs, chosen, strict=True))
        if cost < best[0] or not best[1]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what DISTANCE joins among fps, as a spanning forest.

    A search: each fingerprint taken up is compared with all that are not reached yet, so there are never more
    links than fingerprints, and a dense group is soon exhausted.
    """
    a: list[int] = []
    b: list[int] = []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= DISTANCE
            if near.any():
                found = rest[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                front += list(found)
                rest = rest[~near]
    return a, b


def _links(keyed: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) within the groups (p, v) of rows p, v, fp; a bucket holds many groups."""

    def run(table: pa.Table) -> pa.Table:
        p, v, fps = (table.column(c).to_numpy() for c in ("p", "v", "fp"))
        order = np.lexsort((fps, v, p))
        p, v, fps = p[order], v[order], fps[order].view(np.uint64)
        new = np.ones(len(fps), bool)
        new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
        first = np.append(np.flatnonzero(new), len(fps))
        a, b = [], []
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s > 1:
                x, y = forest(fps[s:e])
                a += x
                b += y
        return pa.table({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})

    bucketed = keyed.withColumn("bucket", F.pmod(F.xxhash64("p", "v"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def _deal_hot(keyed: DataFrame, bits: dict[int, list[int]], hot: int) -> tuple[DataFrame, dict[int, list[int]]] | None:
    """keyed with the groups of more than hot fingerprints dealt out by their other bits, which bits names; None if there are none.

    In such a group at most DISTANCE of the other bits differ, so of DISTANCE + 1 parts of them one is equal.
    """
    large = checkpoint(keyed.groupBy("p", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).drop("n"))
    parts = {r["p"] for r in large.select("p").distinct().collect() if len(bits[r["p"]]) > DISTANCE}  # as many as there are parts
    if not parts:
        return None
    large = large.where(F.col("p").isin(sorted(parts)))
    known, subs = dict(bits), {}
    for p in sorted(parts):
        subs[p] = []
        for k in range(DISTANCE + 1):
            mine = bits[p][k :: DISTANCE + 1]
            subs[p].append((len(known), mine))
            known[len(known)] = [b for b in bits[p] if b not in mine]

    def run(batches):
        for batch in batches:
            ps, v, fps = (batch.column(c).to_numpy() for c in ("p", "v", "fp"))
            for p in np.unique(ps).tolist():
                at = ps == p
                for new, mine in subs[p]:
                    # groups whose mixed values meet by chance only see more comparisons
                    mixed = v[at] * np.int64(0x9E3779B97F4A7C1) + _value(fps[at], mine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mixed), new, np.int32)), pa.array(mixed), pa.array(fps[at])], ["p", "v", "fp"])

    dealt = keyed.join(large, ["p", "v"], "left_semi").select("p", "v", "fp").mapInArrow(run, "p int, v bigint, fp bigint")
    return checkpoint(keyed.join(large, ["p", "v"], "left_anti").unionByName(dealt)), known


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp (a long each) that connect exactly what all links would."""
    parts = plan(distinct)
    keyed = _keyed(distinct, parts)
    rows = distinct.count() * sum(len(_neighbours(len(bits), t)) for bits, t in parts)
    others = {p: [b for b in range(64) if b not in bits] for p, (bits, _) in enumerate(parts)}
    while dealt := _deal_hot(keyed, others, hot):
        keyed, others = dealt
    return _links(keyed, max(4 * partitions(distinct.sparkSession), rows // BUCKET_ROWS) + 1)


def classes(prints: DataFrame) -> DataFrame:
    """fp and component_id (the smallest doc_id reachable) for each distinct fingerprint of prints (doc_id, fp)."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(distinct)).select(F.col("vertex").alias("fp"), "component")
    named = distinct.join(joined, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id for each row of docs."""
    prints = checkpoint(fingerprints(docs, width, doc_id, text))
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id, of repeated (or null, which come first) ids that with the least text."""
    rows, uid = own_ids(docs, doc_id, text)
    found = near_duplicates(rows, width, uid, text)
    chosen = found.groupBy("component_id").agg(F.min("doc_id").alias("_chosen")).select("_chosen").hint("shuffle_hash")
    kept = rows.join(chosen, rows[uid] == chosen["_chosen"], "left_semi")
    return kept if uid == doc_id else kept.drop(uid)
