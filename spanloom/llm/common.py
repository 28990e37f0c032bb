"""What the training-data operators share: projections, checkpoints, let-bindings, block sizes."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts' word pattern excludes it.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text only (other columns, however named, never get in the way); a null text is empty."""
    return docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body holds lambdas that use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def typed(schema: str, frame: DataFrame) -> str:
    """schema with the type that frame's doc_id has."""
    return schema.replace("doc_id bigint", f"doc_id {frame.schema['doc_id'].dataType.simpleString()}", 1)


def checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder (spark.checkpoint.dir); where nothing names one, as in tests, one of our own on this machine, which
    only a local master has executors on."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spanloom-")
        context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt out by a column into a checkpoint that keeps the deal, so that grouping by the column moves nothing.

    An adaptive plan doesn't tell how its result is dealt out, so this one plan is a plain one.
    """
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return checkpoint(df.repartition(partitions(spark), by).sortWithinPartitions(by))
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Hands back to the system what a Python worker has freed: workers are used again, and their neighbours need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def squeezed(frame: DataFrame, text: str, to: str) -> DataFrame:
    """frame with its string column text as compressed bytes, last and named to: for shuffles, where size is what counts."""
    rest = [c for c in frame.columns if c != text]
    ordered = frame.select(*rest, text)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = [None if t is None else pack(t.encode()) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], [*rest, to])
        release()

    schema = T.StructType([*[ordered.schema[c] for c in rest], T.StructField(to, T.BinaryType())])
    return ordered.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_ids(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """docs and the name of a column that tells its rows apart: the id, or, where ids repeat, are null or no whole numbers, a new
    last column (by id, null first, then text; checkpointed, so that it stays the same)."""
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    if whole and docs.groupBy(docs[doc_id].alias("k")).count().where("count > 1 or k is null").isEmpty():
        return docs, doc_id
    uid = "_uid"
    while uid.lower() in [c.lower() for c in docs.columns]:
        uid += "_"
    return checkpoint(docs.orderBy(F.asc_nulls_first(docs[doc_id]), docs[text]).withColumn(uid, F.monotonically_increasing_id())), uid
