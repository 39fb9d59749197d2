"""Embedding whitening: Jacobi-Davidson on distributed centred products.

Components become integers x = floor(256 * c). The fit list, each distinct x
once, is written as blocks of packed rows; every product of its covariance with
a few vectors is one pass over them, (x - mean)' ((x - mean) w) / n, summed by
task and then in levels of ``FAN``, so that the driver meets at most FAN
matrices of the vectors' size. The largest eigenpairs come from
``jacobi_davidson.largest``; rows are then projected where they lie.

Defined results: rows whose vector is null or has null or non-finite components
are left out; a shorter vector is filled up with zeros to the greatest length;
components whose variance is not above the roundings of the trace have no
whitened values and no rows (a fit list of one vector has none); repeated rows
and null ids are kept; an empty table gives no rows. ``deviation`` is exact, and
null where it exceeds a long.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import written
from propcube.llm.jacobi_davidson import largest
from propcube.llm.vectors import integer_vectors, matrix, packed, shape, width

ROWS = 8192  # rows of a packed block
FAN = 64
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


class FitList:
    """Distinct integer vectors as packed blocks, and sums over all of them."""

    def __init__(self, distinct: DataFrame, dim: int, kind: np.dtype):
        self.dim, self.kind = dim, kind

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    x = matrix(b.column("x").slice(lo, ROWS), kind, dim)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["rows"])

        self.blocks = written(distinct.select("x").mapInArrow(pack, "rows binary"), "fit-list")
        self.tasks = self.blocks.rdd.getNumPartitions()

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape_: tuple[int, ...]) -> np.ndarray:
        """The sum of ``part(block)`` over all blocks; ``part`` gives an array
        of ``shape_`` in double precision, or of exact Python integers."""
        kind, dim = self.kind, self.dim

        def add(arrays: Iterator[np.ndarray]) -> pa.RecordBatch:
            out = None
            for a in arrays:
                out = a if out is None else out + a
            cells = [] if out is None else [pickle.dumps(out)]
            return pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], ["sum"])

        def first(batches):
            yield add(part(np.frombuffer(r.as_py(), kind).reshape(-1, dim)) for b in batches for r in b.column("rows"))

        def again(batches):
            yield add(pickle.loads(r.as_py()) for b in batches for r in b.column("sum"))

        sums, tasks = self.blocks.mapInArrow(first, "sum binary"), self.tasks
        while tasks > FAN:
            tasks = -(-tasks // FAN)
            sums = sums.repartition(tasks).mapInArrow(again, "sum binary")
        out = None
        for r in sums.collect():
            a = pickle.loads(bytes(r["sum"]))
            out = a if out is None else out + a
        return np.zeros(shape_) if out is None else out


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Row count and sums by component, as Python integers."""
    low, high = x.astype(np.int64) & 0xFFFFFFFF, x.astype(np.int64) >> 32  # neither sum leaves a long
    return np.array([len(x), *((h << 32) + v for v, h in zip(low.sum(axis=0).tolist(), high.sum(axis=0).tolist()))],
                    dtype=object)


class Whitening:
    """The fitted transformation of a fit list: n, sums, components."""

    def __init__(self, fit: FitList, k: int):
        dim = fit.dim
        sums = fit.total(exact_sums, (1 + dim,))
        self.n, self.sums = int(sums[0]), [int(s) for s in sums[1:]]
        n = max(self.n, 1)
        mean = self.mean = np.array([s / n for s in self.sums])
        spread = fit.total(lambda x: ((x - mean) ** 2).sum(axis=0), (dim,)) / n
        self.trace = float(spread.sum())

        def product(w: np.ndarray) -> np.ndarray:
            return fit.total(lambda x: (c := x - mean).T @ (c @ w), w.shape) / n

        values, vectors = largest(product, dim, k, self.n - 1) if self.trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
        real = values > dim * np.finfo(float).eps * self.trace
        self.values, self.vectors = values[real], vectors[:, real]
        #: what a centred row is multiplied with
        self.turn = self.vectors / np.sqrt(self.values)
        turn = self.turn
        if turn.shape[1]:
            centre = fit.total(lambda x: ((x - mean) @ turn).sum(axis=0), (turn.shape[1],)) / n
            cov = fit.total(lambda x: (c := (x - mean) @ turn - centre).T @ c, (turn.shape[1],) * 2) / n
            self.identity_error = float(np.abs(cov - np.eye(turn.shape[1])).max())
        else:
            self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over components of (n x - S)^2, exact; None beyond a long."""
        most = max(int(np.abs(x.astype(object)).max(initial=0)), 1)
        reach = self.n * most + max(map(abs, self.sums), default=0)
        if x.shape[1] * reach ** 2 < 1 << 63:
            off = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """RESULT of every usable row and each of the ``k`` largest components."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col)
    dim, most = shape(rows)
    if not dim:
        return spark.createDataFrame([], RESULT)
    kind = width(most)
    rows = written(packed(rows, dim, kind).select("id", "x"), "integer-vectors")
    white = Whitening(FitList(rows.select("x").distinct(), dim, kind), k)
    if not len(white.values):
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(white)  # a few vectors

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.values)
        component, explained = np.arange(1, k + 1, dtype=np.int32), w.values / w.trace
        for b in batches:
            x, m = matrix(b.column("x"), kind, dim), b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(component, m)),
                 pa.array(np.full(m * k, w.n)), pa.array([v for v in w.deviations(x) for _ in range(k)], pa.int64()),
                 pa.array(((x - w.mean) @ w.turn).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, w.identity_error))], [f.split()[0] for f in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT).withColumnRenamed("vec_id", id_col)
