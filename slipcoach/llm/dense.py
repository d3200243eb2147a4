"""Sums of count vectors of a fixed length: each task adds up its own, then slices meet in a shuffle.

Defined results: no rows, or slices that no task hands on, count as zeros; the order of tasks and slices changes nothing; a
cell of one task holds less than 2^32, a sum less than 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "slice int, cells binary"


def parts(cells: np.ndarray, slices: int) -> pa.RecordBatch:
    """What a task hands on: the slices of its vector that hold anything. slices divides the length."""
    cut = np.split(cells, slices)
    used = [k for k in range(slices) if cut[k].any()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([cut[k].astype(np.uint32).tobytes() for k in used], pa.binary())], names=["slice", "cells"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column("slice").to_pylist(), batch.column("cells"), strict=True):
            more = np.frombuffer(cells.as_buffer(), np.uint32)
            total[k] = total[k] + more if k in total else more.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "cells"])


def total(blobs: DataFrame, length: int, slices: int) -> np.ndarray:
    """The sum over all tasks, of fixed size whatever the input."""
    out = np.zeros((slices, length // slices), np.uint64)
    for row in blobs.select("slice", "cells").repartition("slice").mapInArrow(_added, SCHEMA).collect():
        out[row["slice"]] += np.frombuffer(row["cells"], np.uint64)
    return out.ravel()
