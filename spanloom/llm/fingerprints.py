"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes finds boundaries, with normalised lengths: the condition is strict up to NORMAL bytes
and loose beyond, so lengths stay near NORMAL, and a change moves only the boundaries near it. A fingerprint is the set of
the chunks' digests with their lengths, written as sorted hexadecimal; the likeness of a to b is the share of a's chunk
bytes whose chunks b has too (containment).

Defined cases: a null text is empty; the empty text has the empty fingerprint, which is like the empty one only; equal
texts have equal fingerprints; rows follow each other by (doc_id, text), nulls first, so repeated ids have an order too (equal
rows an arbitrary one), and an id that very many rows share is split over ranges like any other rows; a single row is its own
successor; a text of any length is chunked whole; columns beside the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from spanloom.llm.common import documents, own_ids, partitions, texts, typed
from spanloom.llm.suffix_dedup import _CODE as CODE
from spanloom.llm.suffix_dedup import Powers, _mix

LEAST, NORMAL, MOST = 16, 48, 192
STRICT, LOOSE = np.uint32(0x7F), np.uint32(0xF)
GEAR = (CODE >> np.uint64(13)).astype(np.uint32)
BLOCK_BYTES = 2_000_000
_POWERS: list[Powers] = []


def _candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks that the strict and the loose condition allow; the hash covers 16 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[width:] += h[:-width] << np.uint32(width)
        h = shifted
    h >>= np.uint32(16)
    loose = np.flatnonzero((h & LOOSE) == 0)
    return loose[(h[loose] & STRICT) == 0] + 1, loose + 1


def chunk(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each chunk of the texts data[begin:end]; all texts take a step at a time."""
    strict, loose = _candidates(data)
    strict, loose = np.append(strict, 1 << 60), np.append(loose, 1 << 60)
    live = np.flatnonzero(end > begin)
    at = begin[live]
    out = []
    while len(live):
        stop = end[live]
        first = strict[np.searchsorted(strict, at + LEAST)]
        second = loose[np.searchsorted(loose, at + NORMAL)]
        cut = np.minimum(np.minimum(np.where(first < at + NORMAL, first, second), at + MOST), stop)
        out.append((live, at, cut))
        more = cut < stop
        live, at = live[more], cut[more]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    text, start, finish = (np.concatenate(x) for x in zip(*out, strict=True))
    return text, start, finish


def fingerprint_arrays(values: list[str]) -> list[np.ndarray]:
    """Per text the sorted distinct chunks: 48 bits of digest, then the length in a byte."""
    encoded = [v.encode() for v in values]
    size = np.fromiter(map(len, encoded), np.int64, len(encoded))
    data = np.frombuffer(b"".join(encoded), np.uint8)
    end = np.cumsum(size)
    text, start, finish = chunk(data, end - size, end)
    if not _POWERS or len(_POWERS[0].up) < MOST:
        _POWERS[:] = [Powers(MOST)]
    # digests per chunk: bytes times powers by place in the chunk, summed between starts
    order = np.lexsort((start, text))
    text, start, finish = text[order], start[order], finish[order]
    if len(data):
        place = np.arange(len(data)) - np.repeat(start, finish - start)
        digest = _mix(np.add.reduceat(CODE[data] * _POWERS[0].up[place], start))
    else:
        digest = np.zeros(0, np.uint64)
    value = (digest >> np.uint64(16)) << np.uint64(8) | (finish - start).astype(np.uint64)
    bounds = np.searchsorted(text, np.arange(len(values) + 1))
    return [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def written(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    return np.concatenate([np.zeros((len(raw), 1), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes in chunks that b has too; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = a & np.uint64(0xFF)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(weight[b[at] == a].sum() / weight.sum())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches):
        for batch in batches:
            values = batch.column("text").to_pylist()
            for a, b in _blocks(values):
                found = [written(x) for x in fingerprint_arrays(values[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(run, typed("doc_id bigint, fingerprint string", plain))


def _blocks(values: list[str]):
    begin, size = 0, 0
    for k, v in enumerate(values):
        if size and size + len(v) > BLOCK_BYTES:
            yield begin, k
            begin, size = k, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)


def with_successors(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, text in the order of uid (whole numbers that tell the rows apart) within each partition: a bucket is a
    range of uid, and its last row (tail = 1) is a copy of the next range's first; after the last range comes the first.

    Only the ranges' bounds and least ids, a row per range, reach the driver.
    """
    n = 4 * partitions(docs.sparkSession)
    ids = docs.select(F.col("uid").alias("id"))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    bounds = np.array(sorted(set(ids.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 20 * n)))).first()[0] or [])), np.int64)

    @pandas_udf("int")
    def bucket(column: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, column.to_numpy(np.int64), side="right").astype(np.int32))

    least = {r["b"]: r["m"] for r in ids.select("id", bucket("id").alias("b")).groupBy("b").agg(F.min("id").alias("m")).collect()}
    filled = sorted(least)
    before = {least[b]: filled[k - 1] for k, b in enumerate(filled)}

    @pandas_udf("array<int>")
    def places(column: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, column.to_numpy(np.int64), side="right")
        return pd.Series([[b, before[i]] if i in before else [b] for b, i in zip(own.tolist(), column.tolist(), strict=True)])

    placed = docs.withColumn("places", places("uid")).select(F.posexplode("places").alias("tail", "bucket"), "uid", "doc_id", "text")
    dealt = placed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "tail", "uid")
    return dealt.select("bucket", "tail", "doc_id", "text")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """rows: doc_id, text, the next document's text."""
    mine = [r[1] for r in rows]
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for _, t, x in rows]
    strange = [k for k, r in enumerate(rows) if k + 1 == len(rows) or r[2] is not mine[k + 1]]
    found = fingerprint_arrays([*mine, *edited, *[rows[k][2] for k in strange]])
    n = len(rows)
    own, changed, following = found[:n], found[n : 2 * n], found[1 : n + 1]
    for k, x in zip(strange, found[2 * n :], strict=True):
        following[k] = x
    columns = [
        pa.array([r[0] for r in rows], kind),
        pa.array([len(t) for t in mine], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([written(x) for x in own]),
        pa.array([written(x) for x in changed]),
        pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SCHEMA.split(", ")])


def compare_successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text, its edited text (the last half taken from the next document) and the likeness of the fingerprints."""

    def run(batches):
        last, rows, size = None, [], 0  # last: bucket, doc_id, text of a row that waits for its successor
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for bucket, tail, key, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
                if last is not None and last[0] == bucket:
                    rows.append((last[1], last[2], value))
                    size += 2 * len(last[2])
                    last = None
                    if size > BLOCK_BYTES:
                        yield _compared(rows, kind)
                        rows, size = [], 0
                if not tail:
                    last = (bucket, key, value)
        if rows:
            yield _compared(rows, kind)

    rows, uid = own_ids(texts(docs, doc_id, text), "doc_id", "text")
    return with_successors(rows.select(F.col(uid).cast("bigint").alias("uid"), "doc_id", "text")).mapInArrow(run, typed(SCHEMA, rows))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_successors(documents(spark, sf_dir))
