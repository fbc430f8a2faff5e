"""Arrow batches of whole texts: a task turns a few rows at a time into Python's objects."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

PIECE_ROWS = 500
PIECE_BYTES = 2_000_000
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession, most: int = PIECE_BYTES) -> None:
    """Bounds the bytes of the session's Arrow batches, where nothing but Spark's default does: a worker keeps the batch that it works on and the next one whole, before anything is cut."""
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, str(most))


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of up to `rows` rows and about `most` bytes, one row at least."""
    for batch in batches:
        each = max(1, min(rows, most * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function `run`, which at its end gives the memory that allocators keep back to the system: workers live on from task to task."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task
