"""Vectors in array columns: which of them count, and as matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tandemtext.functions.text import named


def whole(vector: Column) -> Column:
    """True for a vector that is not null and has finite components only."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def whole_vectors(rows: DataFrame, vector_column: str) -> DataFrame:
    """``vector``, and ``row`` with all columns but that one, of rows whose vector counts."""
    rest = [named(c) for c in rows.columns if c != vector_column]
    return rows.select(
        F.struct(*rest, F.lit(0).alias("_")).alias("row"), named(vector_column).alias("vector")
    ).where(whole(F.col("vector")))


def with_columns(rows: DataFrame, *more: tuple[str, DataType]) -> StructType:
    """The schema of ``row`` and further columns."""
    return StructType([rows.schema["row"], *[StructField(name, kind) for name, kind in more]])


def matrix(column: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """The vectors as rows of doubles; an error if they differ in length."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or dimensions is not None and len(lengths) and lengths[0] != dimensions:
        raise ValueError(f"vectors of {sorted({*lengths.tolist()} | {dimensions or lengths[0]})} components in one column")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def floored(vectors: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as long; an error where that is beyond the limit of exact sums."""
    scaled = np.floor(vectors * float(scale))
    if scaled.size and np.abs(scaled).max() >= limit:
        raise ValueError(f"a component is beyond {limit // scale}, where sums of squares leave 64 bits")
    return scaled.astype(np.int64)
