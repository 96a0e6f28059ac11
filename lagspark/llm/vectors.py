"""Packing of embedding columns for blocked products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """True for vectors that are not null, not zero and hold finite numbers only."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, dim int, vec binary) of the usable rows; vec holds little-endian float32 or float64."""
    single = df.schema[vec_col].dataType.elementType.simpleString() == "float"
    dtype = "<f4" if single else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(usable("vec") & F.col("id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(dtype)
            blobs = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(blobs, pa.binary())], ["id", "dim", "vec"]
            )

    return rows.mapInArrow(run, "id long, dim int, vec binary")


def matrix(blobs: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from packed vectors of one dimension."""
    data = blobs.to_pylist()
    if not data:
        return np.empty((0, dim))
    dtype = "<f4" if len(data[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(data), dtype).reshape(-1, dim).astype(np.float64)
