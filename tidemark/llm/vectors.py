"""Integer vectors: components scaled and floored in Spark, sent to tasks as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components are smaller than this in amount, so that products of vectors with up to 32768 components fit a long.
LARGEST = 1 << 24


def _scaled(x: Column, scale: int) -> Column:
    return x.cast("double") * F.lit(float(scale))


def integer_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows whose ``vector`` is whole (no null or non-finite component, none of ``LARGEST`` or more once scaled), with its integers in its place.

    The comparison is false for infinities and NaN, which Spark takes for larger than any number.
    """
    column = F.col(f"`{vector}`")
    fine = column.isNotNull() & F.forall(column, lambda x: F.coalesce(F.abs(_scaled(x, scale)) < LARGEST, F.lit(False)))
    return rows.filter(fine).withColumn(vector, F.transform(column, lambda x: F.floor(_scaled(x, scale)).cast("int")))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """The lists as rows of one int32 matrix; shorter ones end with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def exact_kind(bound: float):
    """The fastest kind of number in which sums up to ``bound`` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def lengths(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return np.sqrt((wide * wide).sum(axis=1))


def tables_of(batches, vector: str, budget: int):
    """Tables of consecutive batches, cut so that rows times the longest vector stay below ``budget`` (one row at least)."""
    held, rows, width = [], 0, 0
    for batch in batches:
        begin = 0
        sizes = np.diff(batch.column(vector).offsets.to_numpy()).tolist()
        for i, n in enumerate(sizes):
            wider = max(width, n, 1)
            if rows and (rows + 1) * wider > budget:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, begin, wider = [], 0, i, max(n, 1)
            rows, width = rows + 1, wider
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
