"""Summing dense arrays of fixed size over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "piece long, part long, sums binary"
#: Numbers in a row.
PIECE = 1 << 14
#: Groups of tasks that are summed apart before all are.
PARTS = 64


def _row(piece: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["piece", "part", "sums"])


def pieces(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array as rows (piece number, group of tasks, numbers); pieces of
    zeros are left out."""
    context = TaskContext.get()
    part = context.partitionId() % PARTS if context else 0
    flat = array.reshape(-1)
    for at in range(0, len(flat), PIECE):
        if (piece := flat[at : at + PIECE]).any():
            yield _row(at // PIECE, part, piece.astype(np.float64))


def _fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for p in rows:
        for k, part, s in zip(*(c.to_pylist() for c in p.columns)):
            x = np.frombuffer(s)
            sums[k, part] = sums[k, part] + x if (k, part) in sums else x
    for (k, part), t in sums.items():
        yield _row(k, part, t)


def total(rows: DataFrame, shape: tuple[int, ...], task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], groups: int = 12, kind: type = np.float64) -> np.ndarray:
    """Sum over tasks of task(batches), an array of `shape`.  Pieces of one number
    are added up where they meet, one row at a time, first within PARTS groups of
    tasks and then over these, so the last step does not grow with the tasks.  The
    driver gets one array, part after part."""
    return folded(rows.mapInArrow(lambda parts: pieces(task(parts)), SCHEMA), shape, groups, kind)


def folded(rows: DataFrame, shape: tuple[int, ...], groups: int = 12, kind: type = np.float64) -> np.ndarray:
    """Sum of the arrays of `shape` whose pieces (SCHEMA) are given."""
    numbers = int(np.prod(shape))
    many = -(-numbers // PIECE)
    got = rows.repartition("piece", "part").mapInArrow(_fold, SCHEMA)
    got = got.withColumn("part", F.lit(0).cast("long")).repartition(max(1, min(groups, many)), "piece").mapInArrow(_fold, SCHEMA)
    out = np.zeros(many * PIECE, kind)
    for r in got.toLocalIterator():
        x = np.frombuffer(r["sums"])
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] = x
    return out[:numbers].reshape(shape)
