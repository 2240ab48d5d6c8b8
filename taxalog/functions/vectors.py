"""Vector arithmetic: native forms for single expressions, numpy for batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    """Unequal or zero length and zero norm give 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def to_matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted width as one float64 matrix, and which rows those are."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    fits = lengths == width
    flat = vectors.filter(pa.array(fits)).flatten()
    matrix = np.asarray(flat.fill_null(0), dtype=np.float64).reshape(-1, width) if width else np.zeros((0, 0))
    return matrix, np.flatnonzero(fits)


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, max(width, 1), dtype=np.int32)[: rows + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype(np.float32).ravel()))


def project(vector: Column, weights: np.ndarray) -> Column:
    """``W x`` without bias; a vector shorter than W is wide gives zeros."""
    weights = np.ascontiguousarray(weights, dtype=np.float32)
    out_dim, in_dim = weights.shape

    @F.arrow_udf("array<float>")
    def apply(vectors: pa.Array) -> pa.Array:
        result = np.zeros((len(vectors), out_dim), dtype=np.float32)
        cut = pa.compute.list_slice(vectors, 0, in_dim)
        matrix, rows = to_matrix(cut, in_dim)
        result[rows] = matrix.astype(np.float32) @ weights.T
        return to_lists(result)

    return apply(vector)


def masked_mean(rows: DataFrame, keys: list[str], vector: str, dim: int, mask: str | None = None) -> DataFrame:
    """Mean vector of the rows whose mask is 1; zeros where every row is masked.

    One aggregate per dimension: map-side combine leaves one row per key and
    task, where exploding the vectors would multiply the input by ``dim``.
    """
    use = F.lit(True) if mask is None else F.col(mask) == 1
    sums = [F.sum(F.when(use, F.get(F.col(vector), F.lit(i)).cast("double"))).alias(f"s{i}") for i in range(dim)]
    total = rows.groupBy(*keys).agg(F.count(F.when(use, True)).alias("n_used"), *sums)
    mean = [F.coalesce(F.col(f"s{i}") / F.col("n_used"), F.lit(0.0)) for i in range(dim)]
    return total.select(*keys, "n_used", F.array(*mean).alias("mean"))
