"""Tables of vectors in blocks, and blocks of queries against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    x = F.col(vector).cast("array<double>")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(~F.exists(x, odd), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(length.max(initial=0))
    if (length == wide).all():
        return values.reshape(len(length), wide)
    out = np.zeros((len(length), wide), kind)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x for x in (a, b))


def dealt(df: DataFrame, key: str, name: str, blocks: int, other: str, others: int) -> DataFrame:
    """`df` with its row's block as `name`, once for each block `other` of the table that it meets."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def best(group: np.ndarray, score: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` rows of each group with the highest score, ties to the smaller name."""
    order = np.lexsort((name, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < most]
