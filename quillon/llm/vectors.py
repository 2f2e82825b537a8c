"""Vectors as integers, in batches, and small sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries beyond this have no exact squares in a long, so they are an error and not a silent overflow.
LARGEST = 1 << 27


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the lists that are no null and hold neither nulls nor NaN nor infinities, their lengths, their values end to end)."""
    column = column.cast(pa.list_(pa.float64()))
    here = np.flatnonzero(np.asarray(column.is_valid()))
    lists = column.drop_null()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = bad[ends] == bad[ends - lengths]
    return here[fine], lengths[fine], values[np.repeat(fine, lengths)]


def rows_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable lists of this length, a matrix with a row for each)."""
    at, lengths, values = usable(column)
    fits = lengths == dimension
    return at[fits], values[np.repeat(fits, lengths)].reshape(int(fits.sum()), dimension)


def quantised(values: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * value) as 64-bit integers."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"an entry is {LARGEST // scale} or more in size: its squares have no exact sum in a long")
    return scaled.astype(np.int64)


def as_vectors(df: DataFrame, vector_col: str) -> Column:
    return df[vector_col].cast("array<double>")


def summed_cells(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str) -> dict[int, int | float]:
    """Every task gives one array of fixed size; the arrays' sum, cell by cell, added up by Spark.

    Only as many rows as the array has cells reach the driver; cells that are zero in every task are left out.
    """
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fn(batches).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], arrow)], ["cell", "value"])

    wide = "decimal(38,0)" if kind == "long" else "double"
    cells = df.mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum(F.col("value").cast(wide)).alias("value"))
    return {r.cell: int(r.value) if kind == "long" else r.value for r in cells.collect()}
