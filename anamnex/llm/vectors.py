"""What the vector operators share: which vectors take part, and their Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, not all zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
