"""An inverted file with product-quantised residuals beside a table of vectors: codes choose, exact vectors rank."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from strandline.functions.text import cosine
from strandline.operators.search import TILE_QUERIES, TILE_ROWS, Best, best_ranked, matrix_of, objects, pieces, query_blocks
from strandline.sources.scratch import scratch_folder

SAMPLE_ROWS = 50_000
MOST_CELLS = 4_096
WIDTH = 2
CENTRES = 256
ROUNDS = 10
BLOCK_BYTES = 1_000_000
SHARE = 0.75
FIRST = 10
MODEL = "kind string, number int, values array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _means(x: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Centres by k-means over rows, from these."""
    centres = start
    for _ in range(rounds):
        of = np.concatenate([((centres * centres).sum(axis=1) - 2 * (x[a : a + 4_096] @ centres.T)).argmin(axis=1) for a in range(0, len(x), 4_096)])
        order = np.argsort(of, kind="stable")
        filled, first = np.unique(of[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres = centres.copy()
        centres[filled] = sums / np.diff(np.r_[first, len(x)])[:, None]
    return centres


@dataclass
class Model:
    """Centres of the cells, and for each group of `WIDTH` components the centres of what rows leave there; `share` of the rows in each cell of the sample."""

    centres: np.ndarray
    books: list[np.ndarray]
    share: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 7) -> Model:
        x = unit(x)
        draw = np.random.default_rng(seed).permutation(len(x))
        centres = unit(_means(x, x[draw[:cells]], ROUNDS))
        of = (x @ centres.T).argmax(axis=1)
        left = x - centres[of]
        books = []
        for at in range(0, x.shape[1], WIDTH):
            part = left[:, at : at + WIDTH]
            books.append(_means(part, np.unique(part[draw[: CENTRES * 2]], axis=0)[:CENTRES], ROUNDS))
        return cls(centres, books, np.bincount(of, minlength=len(centres)) / len(x))

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of rows."""
        x = unit(x)
        cell = (x @ self.centres.T).argmax(axis=1)
        left = x - self.centres[cell]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = left[:, m * WIDTH : (m + 1) * WIDTH]
            codes[:, m] = ((book * book).sum(axis=1) - 2 * (part @ book.T)).argmin(axis=1)
        return cell.astype(np.int32), codes

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of one cell stand for."""
        return self.centres[cell] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def probed(self, vectors: np.ndarray, share: float) -> np.ndarray:
        """(vectors, cells): the cells nearest to each vector that together hold about that share of the rows."""
        order = np.argsort(-(unit(vectors) @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(self.share[order], axis=1) - self.share[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (before < share) | (np.arange(order.shape[1]) == 0), axis=1)
        return out


class VectorIndex:
    """Codes of the rows of a table, in parts that are added and never changed.

    The model comes from about `SAMPLE_ROWS` rows: cells as many as the root of the rows, up to `MOST_CELLS`.
    Every row is then coded: its cell and a byte for every two components of what its unit vector leaves. A
    search reads the codes of the cells nearest to a query, an eighth of the bytes of the vectors or less, and
    ranks `first` times k of them by their exact vectors, which come from the table. Rows that the table has
    lost since fall out there; new ones are added as a part. Vectors that are null, zero or of another length than
    most match nothing and are not coded.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[str]:
        """Complete generations, oldest first: each has a model and parts."""
        if not self._fs.exists(self._file(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._file(self.path))]
        return sorted((n for n in names if n.startswith("model-") and self._fs.exists(self._file(f"{self.path}/{n}/model/_SUCCESS"))), key=lambda n: int(n.split("-")[1]))

    def _parts(self, folder: str) -> dict[str, int]:
        """The complete parts, and up to which version of the table each goes."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._file(f"{self.path}/{folder}"))]
        return {n: int(m[1]) for n in names if (m := re.fullmatch(r"part-(\d+)-\w+", n)) and self._fs.exists(self._file(f"{self.path}/{folder}/{n}/_SUCCESS"))}

    @property
    def version(self) -> int | None:
        """Up to which version of the table rows are coded; None without an index."""
        folders = self._folders()
        return max(self._parts(folders[-1]).values(), default=None) if folders else None

    def model(self) -> Model:
        rows = self.spark.read.schema(MODEL).parquet(f"{self.path}/{self._folders()[-1]}/model").collect()  # bounded by `MOST_CELLS`
        kinds: dict[str, dict[int, list[float]]] = {}
        for r in rows:
            kinds.setdefault(r["kind"], {})[r["number"]] = r["values"]
        books = [np.array([kinds[f"book{m}"][i] for i in range(len(kinds[f"book{m}"]))]) for m in range(sum(k.startswith("book") for k in kinds))]
        return Model(np.array([kinds["cell"][i] for i in range(len(kinds["cell"]))]), books, np.array(kinds["share"][0]))

    def build(self, rows: DataFrame, version: int = 0, seed: int = 7) -> None:
        """A new generation over the rows (id, path, embedding); readers of the old one go on until it is complete."""
        rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        if not sizes:
            return
        size, n = sizes[0]
        share = min(1.0, SAMPLE_ROWS / n)
        drawn = rows.where((F.size("embedding") == size) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))).select("embedding").limit(2 * SAMPLE_ROWS).toPandas()
        if not len(drawn):  # so few rows that the draw took none
            drawn = rows.where(F.size("embedding") == size).select("embedding").limit(SAMPLE_ROWS).toPandas()
        model = Model.fit(np.array(drawn["embedding"].tolist(), np.float64), min(round(n**0.5), MOST_CELLS, len(drawn)), seed)
        folder = f"model-{len(self._folders()) + 1}-{uuid.uuid4().hex[:8]}"
        told = [("cell", i, c.tolist()) for i, c in enumerate(model.centres)] + [("share", 0, model.share.tolist())]
        told += [(f"book{m}", i, c.tolist()) for m, book in enumerate(model.books) for i, c in enumerate(book)]
        self._write_part(rows, model, folder, version)
        self.spark.createDataFrame(told, MODEL).coalesce(1).write.parquet(f"{self.path}/{folder}/model")
        for old in self._folders()[:-2]:
            self._fs.delete(self._file(f"{self.path}/{old}"), True)

    def add(self, rows: DataFrame, version: int) -> None:
        """Codes more rows with the model that is there."""
        self._write_part(rows, self.model(), self._folders()[-1], version)

    def _write_part(self, rows: DataFrame, model: Model, folder: str, version: int) -> None:
        size = model.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                right = np.flatnonzero(np.asarray(batch["embedding"].value_lengths().fill_null(-1)) == size)
                x = matrix_of(batch["embedding"].take(pa.array(right)), size)
                fine = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1, initial=0) > 0)
                right, x = right[fine], x[fine]
                cell, codes = model.code(x)
                chosen = batch.take(pa.array(right)) if len(right) else batch.slice(0, 0)
                yield pa.RecordBatch.from_arrays([chosen["id"], chosen["path"], pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "path", "cell", "code"])

        schema = StructType([rows.schema["id"], rows.schema["path"], StructField("cell", IntegerType()), StructField("code", BinaryType())])
        coded = rows.select("id", "path", "embedding").mapInArrow(run, schema)
        # rows of a cell lie together, so the statistics of pages tell which to read
        coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{self.path}/{folder}/part-{version}-{uuid.uuid4().hex[:8]}")

    def codes(self) -> DataFrame:
        """(id, path, cell, code) of all parts."""
        folder = self._folders()[-1]
        return self.spark.read.parquet(*[f"{self.path}/{folder}/{p}" for p in self._parts(folder)])

    def follow(self, table) -> None:
        """Brings the codes to the table's newest version: new rows become a part; where half of the rows or more are new, all are coded anew by a new model."""
        manifest, known = table.manifest(), self.version
        if known == manifest["version"]:
            return
        total = sum(f["rows"] - f["marked"] for f in manifest["files"].values())
        new = sum(f["rows"] - f["marked"] for f in manifest["files"].values() if known is not None and f["since"] > known)
        if known is None or 2 * new >= total:
            self.build(table.read(manifest=manifest).select("id", "path", "embedding"), manifest["version"])
        else:
            self.add(table.added_since(known, manifest).select("id", "path", "embedding"), manifest["version"])

    def candidates(self, queries: DataFrame, k: int, share: float = SHARE) -> DataFrame:
        """(query_id, id, score) of the k rows of each query (query_id, embedding) that its codes place first, among the cells that hold about `share` of the rows."""
        codes, model = self.codes(), self.model()
        size = model.centres.shape[1]
        schema = StructType([queries.schema["query_id"], codes.schema["id"], StructField("score", DoubleType())])
        folder, done = scratch_folder(self.spark), []
        for number, (ids, vectors) in enumerate(query_blocks(queries, BLOCK_BYTES)):
            if vectors.shape[1] == size:
                probed = model.probed(vectors, share)
                near = [int(c) for c in np.flatnonzero(probed.any(axis=0))]
                rows = codes if len(near) == probed.shape[1] else codes.where(F.col("cell").isin(near))
                rows.select("id", "cell", "code").mapInArrow(_coded_best(ids, unit(vectors), k, probed, model), schema).write.parquet(f"{folder}/{number}")
                done.append(f"{folder}/{number}")
        found = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        return best_ranked(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)  # parts may hold a row twice

    def top_k_each(self, rows: DataFrame, queries: DataFrame, k: int, share: float = SHARE, first: int = FIRST) -> DataFrame:
        """(query_id, id, score, rank): the `first` times k candidates of each query, ranked by their exact vectors in rows (id, embedding)."""
        chosen = self.candidates(queries, first * k, share).select("query_id", "id")
        asked = queries.select("query_id", F.col("embedding").alias("asked"))
        scored = chosen.join(rows.select("id", "embedding"), "id").join(asked, "query_id")
        return best_ranked(scored.select("query_id", "id", cosine(F.col("embedding"), F.col("asked")).alias("score")), k)

    def rows_near(self, table, vector: Sequence[float], k: int, predicate: Column, share: float = SHARE, first: int = FIRST) -> DataFrame | None:
        """Rows of the table among which the k best for the vector and the predicate are, from the few files that may hold them; None if only all rows can tell.

        If too few of the candidates are there and match, more cells and more candidates follow.
        """
        codes, model = self.codes(), self.model()
        if len(vector) != model.centres.shape[1] or not any(vector):
            return None
        manifest, wanted = table.manifest(), first * k
        total = codes.count()
        while wanted < total:
            probed = model.probed(np.array([vector], np.float64), share)
            near = codes.where(F.col("cell").isin([int(c) for c in np.flatnonzero(probed[0])]))
            run = _coded_best(pa.array([0]), unit(np.array([vector], np.float64)), wanted, probed, model)
            schema = StructType([StructField("query_id", LongType()), codes.schema["id"], StructField("score", DoubleType())])
            found = near.select("id", "cell", "code").mapInArrow(run, schema).distinct()
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
            ids = [r["id"] for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).collect()]  # `wanted` at most
            paths = codes.where(F.col("id").isin(ids)).select(F.col("path").alias("value"))
            rows = table.read(table.files_of(paths, "path", manifest), manifest).where(F.col("id").isin(ids))
            if rows.where(predicate).count() >= k:
                return rows
            wanted, share = 4 * wanted, min(1.0, 2 * share)
        return None


def _coded_best(ids: pa.Array, vectors: np.ndarray, k: int, probed: np.ndarray, model: Model):
    """The k rows of a task that the codes place first for each query, among the cells that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(ids), k), pa.string()
        for batch in batches:
            kind = batch.schema.field("id").type
            cell = np.asarray(batch["cell"])
            for c in np.unique(cell):
                asking = np.flatnonzero(probed[:, c])
                for few in pieces(np.flatnonzero(cell == c), TILE_ROWS) if len(asking) else ():
                    rows = pa.array(few)
                    codes = np.frombuffer(b"".join(batch["code"].take(rows).to_pylist()), np.uint8).reshape(len(rows), -1)
                    own, decoded = objects(batch["id"].take(rows)), model.decoded(c, codes)
                    for some in pieces(asking, TILE_QUERIES):
                        best.offer(some, own, vectors[some] @ decoded.T)
        yield from best.batch(ids, kind)

    return run
