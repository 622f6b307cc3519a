"""Vectors for the vector operators: usable rows, one per id, and matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, and every component there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def one_each(table: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """(id, others, v) of the usable rows; of rows that share an id, the smallest one. Null ids name no row."""
    x = table.filter(F.col(id_col).isNotNull() & usable(vector_col))
    row = F.min(F.struct(*others, F.col(vector_col).cast("array<double>").alias("v"))).alias("r")
    return x.groupBy(F.col(id_col).cast("long").alias("id")).agg(row).select("id", *(f"r.{c}" for c in others), "r.v")


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: type = np.float64) -> np.ndarray:
    """Rows of ``width`` numbers; shorter lists are filled up with zeros."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(x, pa.ChunkedArray):
        x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    lens = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == width).all():
        return np.ascontiguousarray(flat.reshape(len(lens), width), dtype)
    out = np.zeros((len(lens), width), dtype)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(np.arange(len(lens)), lens), at] = flat
    return out


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def firsts(keys: np.ndarray, k: int) -> np.ndarray:
    """Of sorted keys, a mask of the first ``k`` of each."""
    n = len(keys)
    head = np.concatenate([[True], keys[1:] != keys[:-1]])[:n]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    return np.arange(n) - start < k
