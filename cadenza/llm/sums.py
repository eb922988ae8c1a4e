"""Sums of matrices that tasks hold, added up in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A matrix travels in so many stripes, each added up by a task of its own.
STRIPES = 8
STRIPE = "at int, part int, n double, sums binary"


def striped(matrix: np.ndarray, n: float = 1.0) -> Iterator[pd.DataFrame]:
    """A task's matrix as rows of STRIPE; n: what it counts for, added up beside it."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    flat = np.ascontiguousarray(matrix, np.float32).ravel()
    yield pd.DataFrame([(i, part, float(n), piece.tobytes()) for i, piece in enumerate(np.array_split(flat, STRIPES))], columns=["at", "part", "n", "sums"])


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the rows of each (at, part) as they stream by: one stripe for each is in memory, however many rows come."""
    totals: dict[tuple[int, int], list] = {}
    for frame in frames:
        for at, part, n, sums in frame[["at", "part", "n", "sums"]].itertuples(index=False):
            row = np.frombuffer(sums, np.float32)
            held = totals.get((at, part))
            if held is None:
                totals[at, part] = [n, row.astype(np.float64)]
            else:
                held[0] += n
                held[1] += row
    yield pd.DataFrame([(at, part, n, row.astype(np.float32).tobytes()) for (at, part), (n, row) in totals.items()], columns=["at", "part", "n", "sums"])


def matrix_sum(parts: DataFrame, shape: tuple[int, ...], tasks: int) -> tuple[np.ndarray, float]:
    """The sum of the tasks' matrices and of their n; zeros without any.

    A tree: in each level about the square root of the parts that are left
    meet in one task, which adds them while they stream in, so no task holds
    or reads all of them. The driver gets one matrix, as Arrow batches: rows
    that are pickled for Python take many times its size of the JVM's heap.
    """
    left = max(1, tasks)
    while left > 1:
        left = math.ceil(math.sqrt(left)) if left > 16 else 1
        parts = parts.withColumn("part", F.pmod("part", F.lit(left))).repartition(min(STRIPES * left, 4096), "at", "part").mapInPandas(_added, STRIPE)
    rows = parts.select("at", "n", "sums").toArrow()
    size = int(np.prod(shape))
    pieces = [np.zeros(len(p), np.float64) for p in np.array_split(np.empty(size), STRIPES)]
    total = 0.0
    for at, n, sums in zip(*(rows[c] for c in ("at", "n", "sums")), strict=True):
        pieces[at.as_py()] += np.frombuffer(sums.as_buffer(), np.float32)
        total += n.as_py() if at.as_py() == 0 else 0.0
    return np.concatenate(pieces).reshape(shape), total
