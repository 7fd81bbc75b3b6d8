"""Vectors as the operators take them: of the table's most frequent length, all components finite, not zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null or empty, no component null, NaN or infinite, and not all zero."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & sound & F.exists(column, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent length (the smaller one of two as frequent); 0 without vectors."""
    top = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return int(top.d) if top else 0


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)
