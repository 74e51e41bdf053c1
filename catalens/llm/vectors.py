"""Vectors as rows of packed numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is not null, not empty, and has only finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def numbers(column: pa.Array, kind=np.float64) -> list[np.ndarray]:
    """The lists of an Arrow list column as arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    ends = np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])
    return np.split(flat, ends[:-1]) if len(ends) else []


def stacked(blobs: list[bytes], kind) -> np.ndarray:
    """Equally long packed vectors as the rows of a matrix."""
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def batches_of(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def packed_vectors(df: DataFrame, schema: str, make) -> DataFrame:
    """``mapInArrow`` of ``make(batch) -> list of columns`` under ``schema``."""
    from .common import arrow_of, importable

    importable(df.sparkSession)
    target = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(batch)
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)],
                schema=target,
            )

    return df.mapInArrow(run, schema)
