"""Principal components of many rows by block Krylov iteration.

The covariance is only ever multiplied with a few vectors: a pass over the rows gives its product
with a block of ``BLOCK`` vectors, tasks add up their share, and the shares meet in two rounds of
sums by feature range. A pass adds two blocks of features x ``BLOCK``
numbers at the driver, kept until the end; there are at most ``MAX_PASSES`` passes. The rows are centred implicitly. The iteration ends when every component asked for is an
eigenvector up to ``TOLERANCE`` of the largest eigenvalue, or when the vectors span all features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotweave.session import cut_lineage

BLOCK = 40
# Relative residual of an eigenvector, and passes after which the vectors are taken as they are.
TOLERANCE = 1e-9
MAX_PASSES = 25
# Features whose sums meet in one group, and groups that the tasks are dealt to before.
RANGE = 256
DEALT = 64
# Numbers of rows multiplied at a time inside a task.
SLICE = 1 << 21


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        step = max(1, SLICE // width)
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            yield part, part.column("vec").flatten().to_numpy().reshape(part.num_rows, width)


def _sum_by_range(shares: DataFrame, width: int, columns: int) -> np.ndarray:
    """Sum of ``shares(place, share)``: a task's part of a matrix of ``width`` rows, by row range."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in group.column("share").to_pylist()], axis=0)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "share": pa.array([total.tobytes()], pa.binary())})

    schema = "place int, share binary"
    dealt = shares.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(DEALT)))
    once = dealt.groupBy("place", "deal").applyInArrow(add, schema)
    out = np.zeros((width, columns))
    for row in once.groupBy("place").applyInArrow(add, schema).toLocalIterator():
        own = np.frombuffer(row["share"], np.float64).reshape(-1, columns)
        out[row["place"] * RANGE : row["place"] * RANGE + len(own)] = own
    return out


def _over_rows(data: DataFrame, width: int, columns: int, share) -> np.ndarray:
    """Sum over all rows of ``share(rows x width matrix)``, each a width x columns matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, width):
            own = share(x)
            total = own if total is None else total + own
        if total is not None:
            ranges = [total[low : low + RANGE].tobytes() for low in range(0, width, RANGE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ranges)), pa.int32()), pa.array(ranges, pa.binary())], names=["place", "share"])

    return _sum_by_range(data.select("vec").mapInArrow(run, "place int, share binary"), width, columns)


def covariance_components(data: DataFrame, n: int, width: int, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` largest eigenvalues of the covariance of ``data(vec)`` and their vectors, as
    columns; the largest entry of a vector is positive."""
    context = data.sparkSession.sparkContext
    mean = _over_rows(data, width, 1, lambda x: x.sum(axis=0)[:, None])[:, 0] / n
    rng = np.random.default_rng(seed)
    new = np.linalg.qr(rng.standard_normal((width, min(width, max(BLOCK, size)))))[0]
    basis, image = np.empty((width, 0)), np.empty((width, 0))
    for step in range(MAX_PASSES):
        sent = context.broadcast((new, mean @ new))

        def product(x: np.ndarray) -> np.ndarray:
            block, shift = sent.value
            return x.T @ (x @ block - shift)

        image = np.hstack([image, _over_rows(data, width, new.shape[1], product) / (n - 1)])
        basis = np.hstack([basis, new])
        sent.unpersist()
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:size], turn[:, ::-1][:, :size]
        vectors = basis @ turn
        rest = np.linalg.norm(image @ turn - vectors * values, axis=0)
        if basis.shape[1] == width or rest.max() <= TOLERANCE * max(values[0], np.finfo(float).tiny):
            break
        # The next block: the images of the last one, less what the basis already spans (twice,
        # against rounding). Directions that vanish are replaced by random ones.
        new = image[:, -new.shape[1] :]
        new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
        new = new[:, : width - basis.shape[1]]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            weak = np.linalg.norm(new, axis=0) < 1e-10
            new[:, weak] = rng.standard_normal((width, int(weak.sum())))
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign)


def project(data: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``(obs_id, vec)``: products of the rows with the columns of ``vectors``."""
    sent = data.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, size = sent.value.shape
        for part, x in _matrices(batches, width):
            values = pa.array((x @ sent.value).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([part.column("obs_id"), lists], names=["obs_id", "vec"])

    schema = T.StructType([data.schema["obs_id"], T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return data.select("obs_id", "vec").mapInArrow(run, schema)


def principal_components(vectors: DataFrame, limit: int) -> DataFrame:
    """``(obs_id, vec)`` in min(limit, rows - 1, columns - 1) components. Every row has as many
    numbers as the first; the rows are not shifted, which leaves all distances as they are."""
    data = cut_lineage(vectors.select("obs_id", F.col("vec").cast("array<double>").alias("vec")))
    first = data.select(F.size("vec").alias("d")).first()
    n, width = data.count(), first["d"] if first else 0
    size = min(limit, n - 1, width - 1)
    if size < 1:
        raise ValueError(f"{n} rows x {width} columns are too few for components")
    return project(data, covariance_components(data, n, width, size)[1])
