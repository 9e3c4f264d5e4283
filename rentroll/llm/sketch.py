"""Vectors of fixed length that tasks add up: counts by hash, or sums for a small dense matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 64  # at least, and the tasks that add them up
#: Of a chunk at most, so that a batch of them, which Spark bounds by rows alone, is small however many tasks send theirs.
CHUNK_BYTES = 4096


def chunks_of(size: int) -> int:
    """How many chunks a vector of ``size`` bytes has."""
    return max(CHUNKS, -(-size // CHUNK_BYTES))


def chunk_rows(vector: np.ndarray) -> list[tuple[int, bytes]]:
    """A task's vector as (chunk, bytes); chunks without a number other than 0 are left out."""
    return [(i, part.tobytes()) for i, part in enumerate(np.array_split(vector, chunks_of(vector.nbytes))) if part.any()]


def added(rows: DataFrame, dtype: str, how: np.ufunc = np.add) -> DataFrame:
    """(chunk, part) rows with the parts of a chunk added; a task holds its chunks' sums only, however many parts come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(part.as_buffer(), dtype)
                if chunk in sums:
                    how(sums[chunk], values, out=sums[chunk])
                else:
                    sums[chunk] = values.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "part"])

    return rows.repartition(CHUNKS, "chunk").mapInArrow(run, "chunk int, part binary")


def collected(rows: DataFrame, length: int, dtype: str, how: np.ufunc = np.add) -> np.ndarray:
    """The summed vector of ``length`` numbers on the driver; its size is fixed, whatever the input. The tasks' vectors
    that ``chunk_rows`` cut have the same length and type."""
    out = np.array_split(np.zeros(length, dtype), chunks_of(length * np.dtype(dtype).itemsize))
    for chunk, part in added(rows, dtype, how).collect():
        out[chunk] = np.frombuffer(part, dtype)
    return np.concatenate(out)
