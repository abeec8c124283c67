"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Components of larger size would not leave room for exact sums of products in 64 bits.
MOST = 2 ** 40


def whole_vectors(rows: DataFrame, vector_col: str, factor: int, keep: list[str]) -> DataFrame:
    """(columns ``keep``, ``__q`` array of long) of the rows with a vector.

    A component x becomes floor(factor * x), x as a double. Rows whose vector is null or has a
    null, infinite or NaN component are left out; an empty vector stays. A component whose result
    is 2 ** 40 or more in size ends the job with an error: no sum of products would be exact.
    """
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    wide = rows.select(*kept, F.col(f"`{vector_col}`").cast("array<double>").alias("__v"))
    fields = [T.StructField(c, rows.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, T.StructField("__q", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(len(keep)).is_valid())
            lists = batch.column(len(keep))
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # a null is NaN here
            whole = np.floor(flat * float(factor))
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            sound = odd[bounds[1:]] == odd[bounds[:-1]]
            whole = whole[np.repeat(sound, sizes)]
            if len(whole) and np.abs(whole).max() >= MOST:
                raise ValueError(f"a component times {factor} is {MOST} or more in size")
            ends = np.concatenate(([0], np.cumsum(sizes[sound]))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.astype(np.int64)))
            left = batch.filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([*left.columns[:-1], held], schema.names)

    return wide.mapInArrow(run, schema)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of ``width`` numbers; shorter ones are filled up with zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    out[row, np.arange(len(flat)) - np.repeat(begin, sizes)] = flat
    return out
