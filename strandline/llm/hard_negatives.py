"""Hard negatives by product quantisation: lookup tables and stored residual norms bound every score, exact integers decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, in_sample, releasing, sample_share, written

SCALE = 256
WIDTH = 2
CENTRES = 256
SAMPLE_ROWS = 20_000
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
BLOCK_ROWS = 1_024
FIRST_ROWS = 256
BLOCK_ANCHORS = 8_192
TILE_ANCHORS = 1_024
EXACT = float(1 << 53)

POSITIVE_ROWS = "anchor int, id long, score long"
NEGATIVE_ROWS = "anchor int, positive int, id long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part: label and vector there, every component there and finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def whole_components(values: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles that hold whole numbers."""
    return np.floor(SCALE * values)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the batch: the places of its rows, and their whole components."""
    column = batch["embedding"]
    lengths = np.asarray(column.value_lengths())
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        values = np.asarray(column.take(pa.array(at)).flatten(), np.float64)
        yield at, whole_components(values).reshape(len(at), int(size))


def codebooks(sample: np.ndarray, width: int = WIDTH, centres: int = CENTRES, seed: int = 11) -> list[np.ndarray]:
    """Centres of whole numbers for each group of `width` components, by k-means."""
    books = []
    for at in range(0, sample.shape[1], width):
        x = sample[:, at : at + width]
        book = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:centres]], axis=0)
        for _ in range(8):
            of = _nearest(x, book)
            counts = np.bincount(of, minlength=len(book))
            sums = np.stack([np.bincount(of, x[:, j], len(book)) for j in range(x.shape[1])], axis=1)
            book = np.where(counts[:, None] > 0, np.rint(sums / np.maximum(counts, 1)[:, None]), book)
        books.append(book)
    return books


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4_096):
        part = x[at : at + 4_096]
        out[at : at + 4_096] = ((book * book).sum(axis=1) - 2 * (part @ book.T)).argmin(axis=1)
    return out


def quantised(x: np.ndarray, books: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The code of each group of components, and the norm of what each leaves, rounded up."""
    codes = np.zeros((len(x), len(books)), np.uint8)
    left = np.zeros((len(x), len(books)), np.float32)
    for m, book in enumerate(books):
        part = x[:, m * width : (m + 1) * width]
        codes[:, m] = _nearest(part, book)
        norm = np.sqrt(((part - book[codes[:, m]]) ** 2).sum(axis=1))
        left[:, m] = np.nextafter((norm * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))
    return codes, left


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE_ROWS) -> dict[int, list[np.ndarray]]:
    """Codebooks for each length of vectors, from about `sample` rows; lengths that the sample lacks have none, and their rows are all compared exactly."""
    share = sample_share(rows.count(), sample)
    drawn = rows.where(in_sample(F.col("vec_id"), share, "codebook")).select("embedding").limit(2 * sample).toPandas()["embedding"]
    found: dict[int, list[np.ndarray]] = {}
    for size, same in drawn.groupby(drawn.map(len)):
        if size:
            found[int(size)] = codebooks(whole_components(np.array(same.tolist(), np.float64)))
    return found


def indexed(rows: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """Every row with its codes and residual norms, as bytes; none where its length has no codebook."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[bytes | None] = [None] * batch.num_rows
            left: list[bytes | None] = [None] * batch.num_rows
            for at, x in _matrices(batch):
                if (own := books.get(x.shape[1])) is None:
                    continue
                c, r = quantised(x, own)
                for row, code, norm in zip(at.tolist(), c, r, strict=True):
                    codes[row], left[row] = code.tobytes(), norm.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(left, pa.binary())], names=[*batch.schema.names, "codes", "left"])

    return rows.mapInArrow(run, "vec_id long, label long, embedding array<double>, codes binary, left binary")


class _Anchors:
    """A block of anchors of one length: their vectors, and the tables of their scores with every centre."""

    def __init__(self, places: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: list[np.ndarray] | None):
        self.places, self.ids, self.labels, self.x, self.books = places, ids, labels, x, books
        self.largest = np.abs(x).max(initial=0.0)

    def bounds(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchors): the score of what the codes stand for, and how far at most the true one is from it."""
        middle = np.zeros((len(codes), len(self.x)))
        norms = np.zeros((len(self.books), len(self.x)))
        for m, book in enumerate(self.books):
            part = self.x[:, m * WIDTH : (m + 1) * WIDTH]
            middle += (book @ part.T)[codes[:, m]]  # a table of centres by anchors, looked up by code
            norms[m] = np.sqrt((part * part).sum(axis=1))
        # Cauchy-Schwarz in each group; one, and a billionth, for the rounding of doubles
        return middle, (left.astype(np.float64) @ norms) * (1 + 1e-9) + 1 + np.abs(middle) * 1e-12

    def scores(self, x: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact scores of pairs (row of x, anchor)."""
        if self.largest * np.abs(x).max(initial=0.0) * max(x.shape[1], 1) < EXACT:
            if len(rows) * 8 > len(x) * len(self.x):
                return (x @ self.x.T)[rows, anchors].astype(np.int64)
            out = np.empty(len(rows), np.int64)
            for at in range(0, len(rows), 50_000):
                part = slice(at, at + 50_000)
                out[part] = np.einsum("ij,ij->i", x[rows[part]], self.x[anchors[part]]).astype(np.int64)
            return out
        whole = [[int(v) for v in r] for r in x]
        mine = [[int(v) for v in r] for r in self.x]
        return np.array([sum(a * b for a, b in zip(whole[r], mine[q], strict=True)) for r, q in zip(rows.tolist(), anchors.tolist(), strict=True)], dtype=np.int64)


class _Best:
    """For each window, a range of scores of one anchor, the best rows so far: higher scores first, then smaller ids; rows alike in both count once."""

    def __init__(self, count: int, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.k, self.anchors = k, anchors
        self.low, self.high = low.astype(np.float64), high.astype(np.float64)
        self.window, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = self.low.copy()
        self.order = np.argsort(anchors, kind="stable")
        self.starts = np.searchsorted(anchors[self.order], np.arange(count + 1))

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the least and the largest score that still matter; nothing does for one without a window."""
        low, high = np.full(len(self.starts) - 1, np.inf), np.full(len(self.starts) - 1, -np.inf)
        np.minimum.at(low, self.anchors, self.floor)
        np.maximum.at(high, self.anchors, self.high)
        return low, high

    def offer(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(anchors):
            return
        first, count = self.starts[anchors], self.starts[anchors + 1] - self.starts[anchors]
        pair = np.repeat(np.arange(len(anchors)), count)
        window = self.order[np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + first[pair]]
        s = scores[pair]
        keep = (s >= self.floor[window]) & (s <= self.high[window])
        window, ids, s = np.r_[self.window, window[keep]], np.r_[self.id, ids[pair[keep]]], np.r_[self.score, s[keep]]
        order = np.lexsort((ids, -s, window))
        window, ids, s = window[order], ids[order], s[order]
        new = np.r_[True, (window[1:] != window[:-1]) | (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])][: len(window)]
        window, ids, s = window[new], ids[new], s[new]
        starts = np.searchsorted(window, np.arange(len(self.anchors)))
        rank = np.arange(len(window)) - starts[window]
        full = rank == self.k - 1
        self.floor[window[full]] = s[full]
        self.window, self.id, self.score = window[rank < self.k], ids[rank < self.k], s[rank < self.k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(ids, labels, vectors, codes, residual norms) of rows of one length, a few first and then more at a time."""
    size = FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            at, size = at + size, BLOCK_ROWS
            for rows, x in _matrices(part):
                codes = left = None
                if x.shape[1] and part["codes"][int(rows[0])].is_valid:
                    chosen = pa.array(rows)
                    codes = np.frombuffer(b"".join(part["codes"].take(chosen).to_pylist()), np.uint8).reshape(len(rows), -1)
                    left = np.frombuffer(b"".join(part["left"].take(chosen).to_pylist()), np.float32).reshape(len(rows), -1)
                yield np.asarray(part["vec_id"])[rows], np.asarray(part["label"])[rows], x, codes, left


def _least_ids(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of anything: of equal vectors with one label those with the k + 1 least ids."""
    group = np.unique(np.c_[labels, x.view(np.int64).reshape(len(x), -1)], axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    sorted_groups = group[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_groups, sorted_groups)
    return np.sort(order[rank <= k])


def _searching(blocks_of_anchors: list[_Anchors], windows: Callable[[_Anchors], _Best], same_label: bool):
    """The best rows of a task for each window."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [(a, windows(a)) for a in blocks_of_anchors]
        for ids, labels, x, codes, left in _blocks(batches):
            for anchors, best in state:
                if anchors.x.shape[1] != x.shape[1] or not len(best.anchors):
                    continue
                few = _least_ids(ids, labels, x, best.k)
                own, label, vectors = ids[few], labels[few], x[few]
                wanted = (label[:, None] == anchors.labels[None, :]) & (own[:, None] != anchors.ids[None, :]) if same_label else label[:, None] != anchors.labels[None, :]
                low, high = best.reach()
                if codes is not None and anchors.books is not None:
                    middle, error = anchors.bounds(codes[few], left[few])
                    wanted &= (middle + error >= low) & (middle - error <= high)
                else:
                    wanted &= (low <= high)[None, :]
                rows, cols = np.nonzero(wanted)
                best.offer(cols, own[rows], anchors.scores(vectors, rows, cols))
        for anchors, best in state:
            if len(best.window):
                places = anchors.places[best.anchors[best.window]].astype(np.int32)
                columns = [pa.array(places)] + ([] if same_label else [pa.array(best.slot[best.window].astype(np.int32))]) + [pa.array(best.id), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "score"] if same_label else ["anchor", "positive", "id", "score"])

    return run


def _positive_windows(anchors: _Anchors) -> _Best:
    n = len(anchors.ids)
    return _Best(n, np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), POSITIVES)


def _best_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each window of what the tasks found: k rows a task and window at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.repartition(*keys).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, anchor: Column, sample: int = SAMPLE_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, embedding) for which `anchor` holds.

    A score is the integer inner product of the vectors of floor(256 x). An anchor's positives are its best
    five other rows of its label; for each, the best ten rows of other labels whose score is 30 to 90
    hundredths of the positive's. All rows are coded once by codebooks from about `sample` rows and stored
    with the norm of what each group of components leaves. Anchors meet all rows in blocks of
    `block_anchors`: tables of scores with all centres, looked up by code, give a score whose error the norms
    bound; rows that cannot enter a window any more are ruled out for certain, and exact integers
    decide on the rest. A task sends on ten rows a window at most.

    Rows that lack an id, a label or a vector, or have a component that is null or not finite, take no part.
    Vectors of different lengths have no score with each other. Rows with the anchor's id are no positives of
    it. Repeated rows count once, so does a repeated anchor; rows with one id and different vectors are
    rows of their own. A positive whose score is negative has no window; one of 0 takes scores of 0. Ties go by the
    smaller id. An empty table gives no rows; other columns are not read. A score beyond 64 bits is an error.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    books = fit_codebooks(rows, sample)
    index = written(indexed(rows, books), "codes")
    anchors = cut_lineage(index.where(anchor).select("vec_id", "label", "embedding").distinct())
    parts = max(1, -(-anchors.count() // block_anchors))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = []
    for part in range(parts):
        block = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toPandas()
        if len(block):
            found.append(written(_mined(index, block, books), f"negatives-{part}"))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _mined(index: DataFrame, block: pd.DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """The rows of the result for one block of anchors."""
    spark = index.sparkSession
    sets = []
    lengths = block["embedding"].map(len)
    for (size, _), same in block.groupby([lengths, np.arange(len(block)) // TILE_ANCHORS]):
        x = whole_components(np.array(same["embedding"].tolist(), np.float64).reshape(len(same), int(size)))
        sets.append(_Anchors(same.index.to_numpy(), same["vec_id"].to_numpy(np.int64), same["label"].to_numpy(np.int64), x, books.get(int(size))))
    near = _best_rows(index.mapInArrow(_searching(sets, _positive_windows, True), POSITIVE_ROWS), ["anchor"], POSITIVES)
    positives = near.toPandas()
    positives = positives.sort_values(["anchor", "rank"], ignore_index=True)
    low, high = -(-LOW * positives["score"] // 100), HIGH * positives["score"] // 100
    positives = positives[low <= high].reset_index(drop=True)
    anchor_of, slot_of, score_of = (positives[c].to_numpy(np.int64) for c in ("anchor", "rank", "score"))

    def windows(anchors: _Anchors) -> _Best:
        own = np.flatnonzero(np.isin(anchor_of, anchors.places))
        best = _Best(len(anchors.ids), np.searchsorted(anchors.places, anchor_of[own]), -(-LOW * score_of[own] // 100), HIGH * score_of[own] // 100, NEGATIVES)
        best.slot = slot_of[own]
        return best

    hard = _best_rows(index.mapInArrow(_searching(sets, windows, False), NEGATIVE_ROWS), ["anchor", "positive"], NEGATIVES)
    ids = block["vec_id"].to_numpy(np.int64)
    known = pd.DataFrame({"anchor": anchor_of.astype(np.int32), "positive": slot_of.astype(np.int32), "anchor_id": ids[anchor_of], "positive_id": positives["id"].to_numpy(np.int64), "positive_score": score_of})
    named = spark.createDataFrame(pa.Table.from_pandas(known, preserve_index=False)) if len(known) else spark.createDataFrame([], "anchor int, positive int, anchor_id long, positive_id long, positive_score long")
    joined = hard.join(F.broadcast(named), ["anchor", "positive"])  # five rows an anchor of the block at most
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def noisy_labels(rows: DataFrame) -> DataFrame:
    """The rows of the query: where vec_id is divisible by 7 the label is another one."""
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
