"""Whitening of vectors, with the scatter matrix counted on bit planes.

Components become integers. A task takes its rows in batches, shifts each dimension to start
at zero and packs every bit of it, across the rows, into words of 64 rows. The number of common ones
of two planes, weighted by their powers of two, is a term of a cross-product; all sums are
integers. The scatter is centred as integers too (n * sum of products - product of sums), so
a large common offset costs no digit; only then it is divided and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType

from tandemtext.llm.vectors import floored, matrix, whole_vectors, with_columns

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 40
# Components with less than this share of the largest variance have none but rounding.
NOTHING = 1e-13


def packed_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes (dimensions, bits, words) of non-negative integers (rows, dimensions)."""
    rows, dimensions = values.shape
    bits = max(1, int(values.max()).bit_length())
    padded = -(-rows // 64) * 64
    planes = np.zeros((dimensions, bits, padded // 8), np.uint8)
    for b in range(bits):
        plane = np.zeros((dimensions, padded), np.uint8)
        plane[:, :rows] = (values.T >> b) & 1
        planes[:, b] = np.packbits(plane, axis=1)
    return planes.view(np.uint64)


def plane_products(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (dimensions) and cross-products (dimensions, dimensions) of the packed values.

    Python integers: a weight is up to two to twice the number of bits.
    """
    dimensions, bits, _ = planes.shape
    flat = planes.reshape(dimensions * bits, -1)
    weights = np.array([1 << b for b in range(bits)], object)
    sums = np.bitwise_count(planes).sum(2, dtype=np.int64).astype(object) @ weights
    products = np.zeros((dimensions, dimensions), object)
    for i in range(dimensions):
        for a in range(bits):
            common = np.bitwise_count(flat[i * bits :] & planes[i, a]).sum(1, dtype=np.int64)
            products[i, i:] += (common.reshape(-1, bits).astype(object) @ weights) * (1 << a)
    lower = np.tril_indices(dimensions, -1)
    products[lower] = products.T[lower]
    return sums, products


class Scatter:
    """Count, sums and cross-products of integer rows, added up batch by batch."""

    def __init__(self, dimensions: int):
        self.count = 0
        self.sums = np.zeros(dimensions, object)
        self.products = np.zeros((dimensions, dimensions), object)

    def add(self, values: np.ndarray) -> None:
        least = values.min(0)
        sums, products = plane_products(packed_planes(values - least))
        shift, n = least.astype(object), len(values)
        self.count += n
        self.sums += sums + n * shift
        crossed = np.outer(shift, sums)
        self.products += products + crossed + crossed.T + n * np.outer(shift, shift)


def scatter(rows: DataFrame, scale: int) -> tuple[int, list[int], list[list[int]]] | None:
    """Rows, sums and cross-products of floor(scale * x), or None without rows.

    A task reports one row for each pair of dimensions; the driver gets that many in all.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            values = floored(matrix(batch.column(0)), scale, LIMIT)
            if len(values):
                total = total or Scatter(values.shape[1])
                if len(total.sums) != values.shape[1]:
                    raise ValueError("vectors differ in length")
                total.add(values)
        if total is None:
            return
        d = len(total.sums)
        # The number of dimensions goes along, to tell tasks with others.
        cells = [(-1, d, total.count)] + [(i, -1, s) for i, s in enumerate(total.sums)]
        cells += [(i, j, total.products[i, j]) for i in range(d) for j in range(i, d)]
        i, j, value = zip(*cells)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i, pa.int32()),
                pa.array(j, pa.int32()),
                pa.array([Decimal(int(v)) for v in value], pa.decimal128(38, 0)),
            ],
            names=["i", "j", "value"],
        )

    tallies = rows.select("vector").mapInArrow(tally, "i int, j int, value decimal(38,0)")
    summed = tallies.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    found = {(r.i, r.j): int(r.value) for r in summed}
    counts = {j: n for (i, j), n in found.items() if i == -1}
    if not counts:
        return None
    if len(counts) > 1:
        raise ValueError(f"vectors of {sorted(counts)} components in one column")
    [(d, n)] = counts.items()
    sums = [found[i, -1] for i in range(d)]
    return n, sums, [[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


@dataclass
class Whitening:
    """What turns a vector into components of variance one.

    ``sums`` are of floor(scale * x) over ``count`` rows; ``directions`` are unit eigenvectors
    (columns) by falling ``variances``; ``explained`` their shares of the whole variance.
    """

    scale: int
    count: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def factors(self) -> np.ndarray:
        some = self.variances > 0
        return np.where(some, self.directions / np.sqrt(np.where(some, self.variances, 1)), 0)


def fit_whitening(
    vectors: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> Whitening | None:
    """The whitening of all vectors that count, or None if there is none.

    The covariance has divisor n. Vectors that are null or hold null or non-finite components
    don't count; those of different lengths or with a component beyond ``LIMIT`` / ``scale``
    are an error. Directions in which the rows don't vary have variance 0, and their whitened
    values are 0. ``identity_error`` is how far the covariance of the whitened rows is from
    the identity, over the directions that vary: by linearity it follows from the exact
    covariance, whatever rounding the decomposition did.
    """
    found = scatter(whole_vectors(vectors, vector_column), scale)
    if found is None:
        return None
    n, sums, products = found
    d = len(sums)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[c / n**2 for c in row] for row in centred], np.float64).reshape(d, d)
    trace = sum(centred[i][i] for i in range(d)) / n**2
    variances, directions = np.linalg.eigh(covariance)
    variances, directions = variances[::-1][:components], directions[:, ::-1][:, :components]
    variances = np.where(variances > NOTHING * d * max(trace, 0), variances, 0.0)
    model = Whitening(
        scale, n, sums, directions, variances, variances / trace if trace else np.zeros(len(variances)), 0.0
    )
    some = variances > 0
    if some.any():
        factors = model.factors[:, some].astype(np.longdouble)
        apart = factors.T @ covariance.astype(np.longdouble) @ factors - np.eye(some.sum())
        model.identity_error = float(np.abs(apart).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, vector_column: str = "embedding") -> DataFrame:
    """``row`` (all columns but the vector), ``deviation`` and ``whitened`` of each vector that counts.

    The deviation is the exact sum over dimensions of (n*x - S)^2; ``whitened`` has the
    components in order. Without a model there is no row.
    """
    rows = whole_vectors(vectors, vector_column)
    schema = with_columns(rows, ("deviation", DecimalType(38, 0)), ("whitened", ArrayType(DoubleType())))
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    scale, count, sums, factors = model.scale, model.count, model.sums, model.factors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([s / count for s in sums])
        for batch in batches:
            values = floored(matrix(batch.column(1), len(sums)), scale, LIMIT)
            # In 64 bits if the largest difference allows it.
            most = max([count * int(np.abs(values).max(initial=0)) + max(map(abs, sums), default=0), 1])
            exact = values if most**2 * max(len(sums), 1) < 1 << 63 else values.astype(object)
            apart = exact * count - np.array(sums, exact.dtype)
            deviation = (apart * apart).sum(1) if len(sums) else np.zeros(len(values), np.int64)
            whitened = (values - mean) @ factors
            ends = np.arange(len(values) + 1, dtype=np.int32) * factors.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(whitened.reshape(-1))),
                ],
                names=["row", "deviation", "whitened"],
            )

    return rows.mapInArrow(run, schema)
