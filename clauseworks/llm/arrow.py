"""Arrow helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BYTES_AT_ONCE = 4_000_000
TASKS = "spark.clauseworks.tasks"


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Values of a string column, nulls as empty texts."""
    return ["" if x is None else x for x in column.to_pylist()]


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as the session setting ``TASKS`` names, whatever its size; as it is where it's unset.

    A file of one row group is one task. Whoever has such files and more cores sets it (bench.py does); a table of many
    row groups is cut by spark.sql.files.maxPartitionBytes and needs no shuffle.
    """
    tasks = df.sparkSession.conf.get(TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def per_batch(df: DataFrame, schema: str, make: Callable[..., Callable[[pa.RecordBatch], pa.RecordBatch | None]], *args) -> DataFrame:
    """Run ``make(*args)`` once in each task and its result on each Arrow batch of ``df``.

    ``make`` is given by reference, so that what it caches in its module lives as long as the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make(*args)
        for batch in batches:
            for part in slices(batch):
                out = f(part)
                if out is not None:
                    yield out

    return spread(df).mapInArrow(run, schema)


def per_task(df: DataFrame, schema: str, make: Callable[..., tuple[Callable[[pa.RecordBatch], bool], Callable[[], Iterator[pa.RecordBatch]]]], *args) -> DataFrame:
    """Run ``add, flush = make(*args)`` once in each task: ``add`` takes in each slice and says whether what it keeps has
    reached its bound, ``flush`` gives it out and begins anew; it is also called at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = make(*args)
        for batch in batches:
            for part in slices(batch):
                if add(part):
                    yield from flush()
        yield from flush()

    return spread(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``BYTES_AT_ONCE``, or of one row, without a copy: a batch of very long texts
    takes no more memory than one of short ones."""
    if batch.num_rows > 1 and batch.nbytes > BYTES_AT_ONCE:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch
