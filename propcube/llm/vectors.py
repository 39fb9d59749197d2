"""Embedding rows as integer vectors, shared by exact search and whitening."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import ship


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, flag: Column | None = None) -> DataFrame:
    """(id, flag, x array<long>) of the usable rows, x = floor(256 * c) of each
    component as double. Null vectors and those with null or non-finite
    components are left out; ``floor`` saturates at the range of long."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.lit(False) if flag is None else flag).alias("flag"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~odd).select(
        "id", F.coalesce("flag", F.lit(False)).alias("flag"), F.transform("v", lambda c: F.floor(256 * c)).alias("x"))


def shape(rows: DataFrame) -> tuple[int, int]:
    """(greatest length, greatest magnitude) of the vectors ``x`` of ``rows``."""
    high, low = F.max(F.array_max("x")), F.min(F.array_min("x"))
    got = rows.agg(F.max(F.size("x")).alias("d"), high.alias("high"), low.alias("low")).first()
    return got["d"] or 0, max(abs(got["high"] or 0), abs(got["low"] or 0))


def width(most: int) -> np.dtype:
    """The narrowest integer type for components of magnitude ``most``."""
    return np.dtype(next((t for t in ("<i2", "<i4") if most <= np.iinfo(t).max), "<i8"))


def packed(rows: DataFrame, dim: int, kind: np.dtype) -> DataFrame:
    """(id, flag, x binary): components in ``kind``, shorter vectors filled up
    with zeros, so that equal vectors have equal bytes."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            out = np.zeros((len(x), dim), kind)
            sizes = x.value_lengths().to_numpy(zero_copy_only=False)
            out[np.arange(dim) < sizes[:, None]] = x.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("flag"), binary(out)], ["id", "flag", "x"])

    return rows.mapInArrow(pack, "id long, flag boolean, x binary")


def binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize if x.ndim > 1 else x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.data)]).cast(pa.binary())


def matrix(column: pa.Array | pa.ChunkedArray, kind: np.dtype, dim: int) -> np.ndarray:
    """Binary values of equal size as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    first = int(np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset]) if len(column) else 0
    count = len(column) * dim
    return np.frombuffer(data, kind, count, first).reshape(-1, dim) if count else np.zeros((len(column), dim), kind)
