"""Counts of hashed values over all texts, in a table of fixed size.

A task adds up what it sees in one array and gives it out once, in parts; a part's arrays are added as they come, so
neither a task of texts nor one of sums holds more than one array, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauseworks.llm.arrow import per_task, texts

PART = 256  # counters of a part


def _counter(column: str, slots_of: Callable[[list[str]], tuple[np.ndarray, int]], bits: int):
    total, rest = np.zeros(1 << bits, np.int64), [0]

    def add(batch: pa.RecordBatch) -> bool:
        slots, n = slots_of(texts(batch.column(column)))
        total[:] += np.bincount(slots, minlength=len(total))
        rest[0] += n
        return False

    def flush() -> Iterator[pa.RecordBatch]:
        yield given_out(total, rest[0])

    return add, flush


def given_out(total: np.ndarray, n: int) -> pa.RecordBatch:
    """(part, counts) of a task's counters: the parts that aren't all zero, and the number beside them as part -1."""
    table = total.reshape(-1, PART)
    parts = np.flatnonzero(table.any(axis=1))
    rows = [np.array([n]).tobytes(), *(_packed(table[p]) for p in parts)]
    return pa.RecordBatch.from_arrays([pa.array([-1, *parts.tolist()], pa.int32()), pa.array(rows, pa.binary())], ["part", "counts"])


def _packed(counts: np.ndarray) -> bytes:
    """As few bytes for each counter as the largest needs; the length tells how many."""
    most = int(counts.max())
    return counts.astype(next(t for t in WIDTHS if most <= np.iinfo(t).max)).tobytes()


WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def _unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < PART:  # the number beside the counters
        return np.frombuffer(raw, np.int64)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // PART]).astype(np.int64)


def _sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | int = 0
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            total = total + _unpacked(raw)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])


# what Spark reads to choose the form that takes one batch after the other
_sum.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def summed(counted: DataFrame) -> DataFrame:
    """(part, total) of what tasks gave out: ``PART`` counts in a row; part -1 has the sum of the numbers beside them."""
    return counted.groupBy("part").applyInArrow(_sum, "part int, total binary")


def collected(totals: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """The sum of the numbers and the table of ``2 ** bits`` counts on the driver, eight bytes for each."""
    counts, n = np.zeros(1 << bits, np.int64), 0
    for r in totals.toLocalIterator():
        if r["part"] < 0:
            n = int(np.frombuffer(r["total"], np.int64)[0])
        else:
            counts[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["total"], np.int64)
    return n, counts


def table(df: DataFrame, column: str, slots_of: Callable[[list[str]], tuple[np.ndarray, int]], bits: int) -> tuple[int, np.ndarray]:
    """``collected`` counts of ``slots_of``'s slots over all texts."""
    return collected(summed(per_task(df.select(column), "part int, counts binary", _counter, column, slots_of, bits)), bits)
