"""Change sets from a stream: the same step as a batch sync, once for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from strandline.operators.chunk import Chunker
from strandline.operators.embed import Embedder
from strandline.plans.refresh import refresh
from strandline.sources.table import IndexTable

CHANGES = StructType([StructField(c, StringType()) for c in ("path", "status", "text", "seq")])


def latest(changes: DataFrame, key: str = "path", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Of several changes to one key in a batch the last one."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def apply_to(table: IndexTable, chunker: Chunker, embedder: Embedder, repo_id: str, ref: str, normalize: dict[str, bool] | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function for rows of `CHANGES`; a batch that comes again leaves the same rows."""

    def step(batch: DataFrame, number: int) -> None:
        todo = latest(batch).persist()
        try:
            files = todo.where(F.col("status") != "D").select("path", "text")
            if not todo.isEmpty():
                refresh(table, todo.select("path"), files, chunker, embedder, repo_id, ref, f"batch-{number}", f"batch-{number}", normalize)
        finally:
            todo.unpersist()

    return step


def follow(changes: DataFrame, table: IndexTable, chunker: Chunker, embedder: Embedder, repo_id: str, ref: str, checkpoint: str) -> StreamingQuery:
    """Starts to keep the table in step with a stream of changes; `checkpoint` holds how far it has come."""
    return changes.writeStream.foreachBatch(apply_to(table, chunker, embedder, repo_id, ref)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
