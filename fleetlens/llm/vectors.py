"""Vector columns: which rows count, one width for all, Arrow batches as NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: Column | str) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    column = F.col(column) if isinstance(column, str) else column
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return column.isNotNull() & F.forall(F.transform(column, lambda x: x.cast("double")), good)


def width(df: DataFrame, column: str, multiple: int = 1) -> int:
    """Components of the longest vector, up to the next multiple; shorter ones count as padded with zeros."""
    most = df.agg(F.max(F.size(column))).first()[0] or 0
    return -(-most // multiple) * multiple


def matrix(column: pa.Array, columns: int) -> np.ndarray:
    """A row for each vector of an Arrow list column without nulls, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == columns).all():
        return values.reshape(len(column), columns)
    out = np.zeros((len(column), columns), values.dtype if len(values) else float)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out
