"""Filtered cosine top-k: one query by expressions, many by blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strandline.functions.batches import releasing, small_batches
from strandline.functions.text import cosine
from strandline.sources.scratch import scratch_folder

QUERY_BYTES = 4_000_000
TILE_ROWS, TILE_QUERIES = 1_024, 256  # scores that a task holds at once: 2 MB


def top_k(index: DataFrame, vector: Sequence[float], k: int, predicate: Column | None = None, id_column: str = "id") -> DataFrame:
    """The k rows most similar to the vector, with score; equal scores by id.

    The filter runs before the scores; the sort keeps k rows a task.
    """
    rows = index if predicate is None else index.where(predicate)
    query = F.array(*[F.lit(float(x)) for x in vector]) if len(vector) else F.array().cast("array<double>")
    scored = rows.where(F.col("embedding").isNotNull()).withColumn("score", cosine(F.col("embedding"), query))
    return scored.orderBy(F.desc("score"), id_column).limit(max(k, 0))


def results(found: DataFrame) -> DataFrame:
    """The answer's columns, without rows that lack an id, a path or a text; so there may be fewer than k."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    rows = found.where((F.trim(filled("id")) != "") & (F.trim(filled("path")) != "") & (F.trim(filled("text")) != ""))
    columns = [F.col("id").alias("doc_id"), *[filled(c).alias(c) for c in ("path", "heading_path", "chunk_type", "text", "content_commit")]]
    return rows.select(*columns, F.coalesce("score", F.lit(0.0)).alias("score"))


class Best:
    """The k best ids and scores of each query so far: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0)] * queries
        self.ids: list[np.ndarray | None] = [None] * queries
        self.floor = np.full(queries, -np.inf)  # the k-th best score, once there are k

    def offer(self, asking: np.ndarray, own: np.ndarray, score: np.ndarray) -> None:
        """Rows with ids `own` and scores (queries asking, rows)."""
        if self.k < 1:
            return
        # all that tie with the k-th stay for the exact order
        able = ~(score < self.floor[asking, None] - 1e-12)
        for at in np.flatnonzero(able.any(axis=1)).tolist():
            q, rows = int(asking[at]), np.flatnonzero(able[at])
            found = score[at, rows]
            if len(found) > self.k:
                keep = found >= np.partition(found, len(found) - self.k)[len(found) - self.k] - 1e-12
                found, rows = found[keep], rows[keep]
            s, i = np.r_[self.scores[q], found], own[rows] if self.ids[q] is None else np.r_[self.ids[q], own[rows]]
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]
            if len(order) == self.k:
                self.floor[q] = s[order[-1]]

    def batch(self, ids: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) of all that was found."""
        counts = [len(s) for s in self.scores]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), counts))), pa.array(np.concatenate([i for i in self.ids if i is not None]), kind), pa.array(np.concatenate(self.scores))], names=["query_id", "id", "score"])


def pieces(numbers: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The numbers, some at a time: the scores of a piece of the queries and one of the rows take little room, however many there are."""
    for at in range(0, len(numbers), size):
        yield numbers[at : at + size]


def objects(column: pa.Array) -> np.ndarray:
    """Ids as numbers in little room, or else as Python's own objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), size)


def _best_of_each(ids: pa.Array, vectors: np.ndarray, k: int, probed: np.ndarray | None = None):
    """The k best rows of each query in a task. With `probed` (queries, cells) a query looks at rows of its own cells only."""
    lengths = np.linalg.norm(vectors, axis=1)
    everyone = np.arange(len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(ids), k), pa.string()
        for batch in batches:
            kind = batch.schema.field("id").type
            sizes = np.asarray(batch["embedding"].value_lengths().fill_null(-1))
            cell = np.asarray(batch["cell"]) if probed is not None else np.zeros(batch.num_rows, np.int64)
            for c in np.unique(cell):
                rows = np.flatnonzero((cell == c) & (sizes >= 0))
                asking = everyone if probed is None else np.flatnonzero(probed[:, c])
                for few in pieces(rows, TILE_ROWS) if len(asking) else ():
                    own, right = objects(batch["id"].take(pa.array(few))), sizes[few] == vectors.shape[1]
                    matrix = matrix_of(batch["embedding"].take(pa.array(few[right])), vectors.shape[1])
                    norm = np.linalg.norm(matrix, axis=1)
                    for some in pieces(asking, TILE_QUERIES):
                        score = vectors[some] @ matrix.T
                        size = lengths[some, None] * norm[None, :]
                        np.divide(score, size, out=score, where=size > 0)
                        score[~(size > 0)] = 0
                        if len(matrix) < len(few):
                            whole = np.zeros((len(some), len(few)))
                            whole[:, right] = score
                            score = whole
                        best.offer(some, own, score)
        yield from best.batch(ids, kind)

    return run


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The queries (query_id, embedding) in blocks of about `block_bytes` of vectors: ids and vectors of one length."""
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    about = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()
    parts = max(1, -(-int(about[1]) // block_bytes))
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        for size, same in mine.groupby(mine["embedding"].map(len)):
            kind = to_arrow_type(queries.schema["query_id"].dataType)
            yield pa.array(same["query_id"].tolist(), kind), np.array(same["embedding"].tolist(), dtype=np.float64).reshape(len(same), size)


def _each(rows: DataFrame, queries: DataFrame, k: int, block_bytes: int, probes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """A block's best rows are written before the next one starts, so neither plan nor memory grows with the queries."""
    spark = rows.sparkSession
    schema = StructType([queries.schema["query_id"], rows.schema["id"], StructField("score", DoubleType())])
    folder, written = scratch_folder(spark), []
    small_batches(spark)
    for number, (ids, vectors) in enumerate(query_blocks(queries, block_bytes)):
        rows.mapInArrow(releasing(_best_of_each(ids, vectors, k, probes(vectors) if probes else None)), schema).write.parquet(f"{folder}/part={number}")
        written.append(f"{folder}/part={number}")
    return best_ranked(spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema), k)


def best_ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k_each(index: DataFrame, queries: DataFrame, k: int, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, embedding) over an index (id, embedding), ids of any kind.

    A block of queries goes to all tasks; a task sends on its k best rows a query, and these alone meet in a shuffle.
    """
    return _each(index.select("id", "embedding"), queries, k, block_bytes)


def cells(index: DataFrame, count: int = 16, seed: int = 7, sample: int = 20_000) -> np.ndarray:
    """Centres of an inverted file: k-means over unit vectors of a bounded sample; every row is then assigned to one."""
    n = index.count()
    share = min(1.0, sample / max(n, 1))
    rows = index.where(F.col("embedding").isNotNull()).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("embedding").limit(sample).toPandas()
    x = np.array(rows["embedding"].tolist(), dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(count, len(x))]]
    for _ in range(12):
        of = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    return centres


def with_cell(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cell, the nearest centre: a partition column for the table, so that a query reads a few partitions. Vectors of another length, which match nothing, lie in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            right = np.flatnonzero(np.asarray(batch["embedding"].value_lengths().fill_null(-1)) == centres.shape[1])
            if len(right):
                matrix = np.asarray(batch["embedding"].take(pa.array(right)).flatten(), dtype=np.float64).reshape(len(right), -1)
                cell[right] = (matrix @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    rows = index.where(F.col("embedding").isNotNull())
    small_batches(index.sparkSession)
    return rows.mapInArrow(releasing(run), StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


def nearest_cells(centres: np.ndarray, vectors: np.ndarray, probes: int) -> np.ndarray:
    """(vectors, cells): whether a cell is one of the `probes` nearest to the vector."""
    out = np.zeros((len(vectors), len(centres)), bool)
    if vectors.shape[1] == centres.shape[1]:
        order = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :probes]
        np.put_along_axis(out, order, True, axis=1)
    return out


def inverted_file(index: DataFrame, path: str, count: int = 16, seed: int = 7) -> np.ndarray:
    """Writes the rows (id, embedding, ...) with `cell` as partition column to `path`; gives the centres, by which queries find their cells."""
    centres = cells(index, count, seed)
    with_cell(index, centres).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    return centres


def approximate_top_k(celled: DataFrame, centres: np.ndarray, vector: Sequence[float], k: int, probes: int = 12, predicate: Column | None = None, id_column: str = "id") -> DataFrame:
    """Top k among the rows of the `probes` cells nearest to the vector; exact once all cells are probed. On a stored inverted file the other cells are not read."""
    near = np.flatnonzero(nearest_cells(centres, np.asarray([vector], dtype=np.float64), probes)[0])
    return top_k(celled.where(F.col("cell").isin([int(c) for c in near])), vector, k, predicate, id_column).drop("cell")


def approximate_top_k_each(celled: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 12, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """As `top_k_each` over rows (id, embedding, cell), but each query meets only the rows of the `probes` cells nearest to it; exact once all are probed."""
    return _each(celled.select("id", "embedding", "cell"), queries, k, block_bytes, lambda vectors: nearest_cells(centres, vectors, probes))
