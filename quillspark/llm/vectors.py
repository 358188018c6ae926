"""Vectors in tables: which take part, and how Arrow batches of them become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def common_size(df: DataFrame, v: str) -> int:
    """The most frequent length of usable vectors, the smaller of equals; 0 if there are none."""
    r = df.where(usable(F.col(v))).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return r.d if r else 0


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
