"""Shared plumbing: bounded Arrow batches, materialised tables, sizes, packed arrays."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread, staged

BATCH_ROWS = 2000
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker never holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # other C libraries than glibc have none


def release() -> None:
    """Gives freed memory back to the system. Workers outlive their tasks: what one stage leaves adds to the next one's needs."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(f):
    """f on a group (one table in, or two of a cogroup), with `release` after it. Spark tells the kinds apart by their arguments."""

    def one(t: pa.Table) -> pa.Table:
        try:
            return f(t)
        finally:
            release()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    return two if f.__code__.co_argcount == 2 else one


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple = ()) -> DataFrame:
    """Two columns, whatever else the input has: doc_id as long, text with null as empty; and `more`."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *more,
    )


materialise = staged


def estimated_bytes(df: DataFrame) -> int:
    """Size of the input as the optimizer knows it (file sizes for a scan); reads no rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, bytes_each: int, least: int, most: int = 1 << 20) -> int:
    return min(most, max(least, -(-estimated_bytes(df) // bytes_each)))


def column_bytes(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and n + 1 offsets into it."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offs = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes, most alike bytes side by side, so that the shuffle's codec shrinks them."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()
