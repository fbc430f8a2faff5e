"""A proximity graph of vectors: neighbours by rounds of joins, queries by a beam that walks inside each part."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.operators.search import Best, best_ranked, matrix_of, objects, query_blocks
from strandline.sources.scratch import scratch_folder

DEGREE = 24
SWEEPS = 3
ROUNDS = 4
NEAR = 12
PART_ROWS = 50_000
BEAM = 128
BLOCK_BYTES = 1_000_000
EDGES = "u long, v long, score double"


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by `key`, some at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            ends = np.flatnonzero(np.diff(np.asarray(batch[key])))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if held and held[-1][key][-1] != batch[key][0]:
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _best_pairs(nodes: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a few nodes the `most` others that are most similar to it."""
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    near = np.argpartition(-score, min(most, len(nodes) - 1) - 1, axis=1)[:, :most] if len(nodes) > 1 else np.zeros((len(nodes), 0), np.int64)
    u = np.repeat(nodes, near.shape[1])
    return u, nodes[near.ravel()], np.take_along_axis(score, near, axis=1).ravel()


def _swept(window: int):
    """Edges between rows that lie close together in a sorted sweep of their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch["vector"], len(batch["vector"][0])) if batch.num_rows else np.zeros((0, 1))
            node, part = np.asarray(batch["node"]), np.asarray(batch["part"])
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                for at in range(0, len(mine), window):
                    rows = mine[at : at + window]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best_pairs(node[rows], x[rows], NEAR)], names=["u", "v", "score"])

    return run


def _introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the neighbours of a node: a neighbour's neighbour is likely one as well."""
    for table in _groups(batches, "center"):
        table = table.combine_chunks()
        center, node = table["center"].to_numpy(), table["node"].to_numpy()
        x = matrix_of(table["vector"].chunk(0), len(table["vector"][0]))
        found = [_best_pairs(node[rows], x[rows], NEAR) for rows in np.split(np.arange(len(center)), np.flatnonzero(np.diff(center)) + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["u", "v", "score"])


def _closest(edges: DataFrame, degree: int) -> DataFrame:
    """The `degree` best edges of each node, each once."""
    best = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    return edges.groupBy("u", "v").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= degree).drop("n")


def build_graph(rows: DataFrame, path: str, degree: int = DEGREE, rounds: int = ROUNDS, part_rows: int = PART_ROWS) -> None:
    """Writes the graph of the rows (id, embedding) to `path`: (part, node, id, vector, near), the neighbours by node.

    Rows fall by a hash into parts of about `part_rows`; a node's neighbours are of its part, so that a task can
    walk there. First neighbours come from sweeps along random directions; in each round all neighbours of a
    node, those that name it as well, meet, and the best pairs stay (nearest-neighbour descent): joins and
    windows over edges, in which no node has more than twice `degree`. Rows without vector, with a zero vector or one
    of another length than most match nothing and are not in the graph.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark)
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size, count = (size[0]["size"], size[0]["count"]) if size else (0, 0)
    parts = max(1, math.ceil(count / part_rows))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.where(F.size("embedding") == size).withColumn("length", length).where((F.col("length") > 0) & (F.col("length") < float("inf")))
    unit = unit.select("id", F.transform("embedding", lambda x: x / F.col("length")).alias("vector"))
    nodes = _kept(unit.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.monotonically_increasing_id().alias("node"), "id", "vector"), f"{folder}/nodes")
    # half the bytes are enough to tell neighbours; the walks have the whole numbers
    single = F.col("vector").cast("array<float>").alias("vector")
    edges = None
    for sweep in range(SWEEPS):
        direction = np.random.default_rng(sweep).normal(size=max(size, 1)).tolist()
        along = F.aggregate(F.zip_with("vector", F.array(*[F.lit(d) for d in direction]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        sorted_ = nodes.select("part", "node", single, along.alias("along")).repartitionByRange("part", "along").sortWithinPartitions("part", "along")
        found = sorted_.select("part", "node", "vector").mapInArrow(_swept(4 * degree), EDGES)
        edges = found if edges is None else edges.unionByName(found)
    edges = _kept(_closest(edges, degree), f"{folder}/edges-0")
    known = nodes.select("node", single)
    for n in range(1, rounds + 1):
        back = _closest(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"), degree)
        around = edges.select("u", "v").union(back.select("u", "v")).distinct().select(F.col("u").alias("center"), F.col("v").alias("node"))
        met = around.join(known, "node").repartition("center").sortWithinPartitions("center").select("center", "node", "vector").mapInArrow(_introduced, EDGES)
        edges = _kept(_closest(edges.unionByName(met), degree), f"{folder}/edges-{n}")
    both = edges.unionByName(_closest(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"), degree))
    near = both.groupBy("u").agg(F.array_distinct(F.collect_list("v")).alias("near"))  # twice the degree at most
    joined = nodes.join(near, F.col("node") == F.col("u"), "left").drop("u")
    joined.repartition("part").sortWithinPartitions("part").write.parquet(path)


def _walked(ids: pa.Array, vectors: np.ndarray, k: int, beam: int):
    """The k best rows of each query that a walk over the graph of each part meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(ids), k), pa.string()
        for table in (t.filter(pa.compute.equal(t["part"], p)) for t in _groups(batches, "part") for p in pa.compute.unique(t["part"])):
            table = table.combine_chunks()
            kind, node = table.schema.field("id").type, table["node"].to_numpy()
            x, own = matrix_of(table["vector"].chunk(0), vectors.shape[1]), objects(table["id"].chunk(0))
            order = np.argsort(node)
            near = [order[np.searchsorted(node, np.array(v, np.int64), sorter=order)] if v else order[:0] for v in table["near"].to_pylist()]
            first = np.unique(np.linspace(0, len(node) - 1, 16).astype(np.int64))
            for q, vector in enumerate(vectors):
                places, scores = _beam(x, near, first, vector, beam)
                best.offer(np.array([q]), own[places], scores[None, :])
        yield from best.batch(ids, kind)

    return run


def _beam(x: np.ndarray, near: list[np.ndarray], first: np.ndarray, vector: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks from the nodes `first` to ever more similar ones, `beam` of them in mind; all that it keeps at the end, with scores."""
    seen = np.zeros(len(x), bool)
    seen[first] = True
    scores = x[first] @ vector
    kept = sorted(zip(scores.tolist(), first.tolist(), strict=True))
    todo = [(-s, i) for s, i in kept]
    heapq.heapify(todo)
    heapq.heapify(kept)
    while todo:
        s, i = heapq.heappop(todo)
        if len(kept) >= beam and -s < kept[0][0]:
            break
        new = near[i][~seen[near[i]]]
        seen[new] = True
        for t, j in zip((x[new] @ vector).tolist(), new.tolist(), strict=True):
            if len(kept) < beam or t > kept[0][0]:
                heapq.heappush(todo, (-t, j))
                (heapq.heappush if len(kept) < beam else heapq.heapreplace)(kept, (t, j))
    return np.array([j for _, j in kept]), np.array([t for t, _ in kept])


def graph_top_k_each(spark: SparkSession, path: str, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, embedding) by the stored graph: a walk in every part, whose best rows meet in one shuffle.

    The parts are dealt out once for all blocks of queries. A task holds one part at a time. With a `beam` as large as a part all that can be reached is met.
    """
    graph = spark.read.parquet(path)
    schema = StructType([queries.schema["query_id"], graph.schema["id"], StructField("score", DoubleType())])
    size = graph.select(F.size("vector")).first()
    folder, done = scratch_folder(spark), []
    parts = graph.repartition("part").sortWithinPartitions("part").select("part", "node", "id", "vector", "near").persist(StorageLevel.DISK_ONLY)
    try:
        for number, (ids, vectors) in enumerate(query_blocks(queries, BLOCK_BYTES)):
            if size and vectors.shape[1] == size[0]:
                unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
                parts.mapInArrow(_walked(ids, unit, k, max(beam, k)), schema).write.parquet(f"{folder}/{number}")
                done.append(f"{folder}/{number}")
    finally:
        parts.unpersist()
    return best_ranked(spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema), k)
