"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, kept_by_worker, ranked, releasing, small_batches

CAPACITY = 4096
END_ID = 1
WORD_END = "</w>"
MARKS = ".,;:!?#%&$*)\"'-"
CLASSES = 48
ROUNDS = 240
LARGE = 256
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)
CACHE = 300_000
BLOCK_CHARS = 4_000_000


def tokenizer_path() -> str:
    """Where the public vocabulary of the packing query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _vocabulary(path: str):
    """The tokenizer's batch encoder, which ids end a unit, and the ids of words kept so far."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    # letters alone make one unit, whose last id is one of these; a vocabulary without such ids has each word encoded for itself
    ends = np.zeros(made.get_vocab_size(), bool)
    ends[[i for token, i in made.get_vocab().items() if token.endswith(WORD_END)]] = True
    return made.encode_batch_fast, ends, _Known()


class _Known(dict):
    """Ids of words: those that are kept and, behind them, those of the block in hand."""

    block: dict[str, bytes]

    def __missing__(self, word: str) -> bytes:
        return self.block[word]


def _pieces(path: str | None, capacity: int, cache_size: int):
    """Pieces of each document. Texts split at blanks and line ends, where every token ends; words repeat, so their ids are kept."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary = path or tokenizer_path()
        encode, ends, ids = kept_by_worker(("packing", vocabulary), lambda: _vocabulary(vocabulary))
        end = np.uint32(END_ID).tobytes()

        def each(words: list[str]) -> Iterator[tuple[str, bytes]]:
            for first in range(0, len(words), 20_000):
                part = words[first : first + 20_000]
                yield from zip(part, (array("I", e.ids).tobytes() for e in encode(part, add_special_tokens=False)), strict=True)

        def lettered(words: list[str]) -> Iterator[tuple[str, bytes]]:
            """Ids of words of letters alone: many at once, cut after the ids that end a unit, if these are as many as the words."""
            for first in range(0, len(words), 2_000):
                part = words[first : first + 2_000]
                found = np.array(encode([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = (np.flatnonzero(ends[found]) + 1) * 4
                if len(cuts) == len(part):
                    data = found.tobytes()
                    yield from zip(part, (data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)), strict=True)
                else:
                    yield from each(part)

        def learned(words: set[str]) -> dict[str, bytes]:
            """Ids of the words that are not kept; while there is room, they are kept from now on. Frequent words come early."""
            missing = words.difference(ids)
            # marks behind letters are units of their own; letters beyond Latin-1 may come apart in the normal form and join the marks
            bodies = {w: body for w in missing if (body := w.rstrip(MARKS)) != w and body.isalpha() and body[-1] < "\u0100"}
            parts = missing.difference(bodies).union(bodies.values(), (w[len(body) :] for w, body in bodies.items())).difference(ids)
            new = dict(lettered([p for p in parts if p.isalpha()]))
            new.update(each([p for p in parts if p not in new]))
            part_ids = new.copy()
            for w, body in bodies.items():
                tail = w[len(body) :]
                new[w] = (part_ids.get(body) or ids[body]) + (part_ids.get(tail) or ids[tail])
            if len(ids) + len(new) <= cache_size:
                ids.update(new)
            return new

        def coded(texts: list[str]) -> Iterator[bytes]:
            split = [t.replace("\n", " ").split(" ") for t in texts]
            ids.block = learned({w for words in split for w in words})
            for words in split:
                yield b"".join(map(ids.__getitem__, words)) + end
            ids.block = {}

        def cut(doc_ids: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
            of, out = [], []
            for row, data in enumerate(coded(texts)):
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start : start + 4 * capacity]
                    of.append(row)
                    out.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(doc_ids).take(pa.array(of)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        # some texts at a time, whatever the batches: few share no words, and the words of too many take much room
        doc_ids: list[pa.Array] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            column = batch.column(1)
            at = 0
            for n, text in enumerate(column.to_pylist(), 1):
                texts.append(text or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield cut([*doc_ids, batch.column(0).slice(at, n - at)], texts)
                    doc_ids, texts, size, at = [], [], 0, n
            doc_ids.append(batch.column(0).slice(at))
        if texts:
            yield cut(doc_ids, texts)

    return run


def token_pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, capacity, CACHE), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how many of each size fill `capacity` at the largest value."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes, values = sizes[order], values[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -1
        if n := fits[c]:
            gain = best[c - sizes[:n]] + values[:n]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], choice[c] = gain[k], k
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if (k := choice[c]) < 0:
            c -= 1
        else:
            counts[order[k]] += 1
            c -= int(sizes[k])
    return counts


def configuration_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Near-optimal fractional cover of the demand by configurations, by multiplicative weights.

    A class's weight falls as its demand is met; pricing asks the knapsack for the configuration that
    covers the most weight; the sum is scaled so that every demand is met.
    """
    weight = np.ones(len(sizes))
    covered = np.zeros(len(sizes))
    used: dict[tuple[int, ...], float] = {}
    step = 0.1
    for _ in range(rounds):
        counts = best_configuration(sizes, weight / demand, capacity)
        taken = counts > 0
        amount = float((demand[taken] / counts[taken]).min())
        used[tuple(counts)] = used.get(tuple(counts), 0.0) + amount
        covered += amount * counts / demand
        weight = np.exp(-(covered - covered.min()) * step / max(step, 0.02) / 2)
    scale = 1 / max(float(covered.min()), 1e-9)
    return [(np.array(c, np.int64), x * scale) for c, x in used.items()]


class _Runs:
    """Sequences as runs of equal filling: their number follows the distinct lengths, not the documents."""

    def __init__(self, capacity: int):
        self.next_id = 0
        self.capacity = capacity
        self.by_free: dict[int, list[tuple[int, int, tuple[tuple[int, int], ...]]]] = {}
        self.frees: list[int] = []

    def add(self, free: int, run: tuple[int, int, tuple[tuple[int, int], ...]]) -> None:
        if free not in self.by_free:
            self.by_free[free] = []
            bisect.insort(self.frees, free)
        self.by_free[free].append(run)

    def open(self, items: tuple[tuple[int, int], ...], count: int) -> None:
        self.add(self.capacity - sum(n * k for n, k in items), (self.next_id, count, items))
        self.next_id += count

    def fit(self, length: int, count: int) -> None:
        """Each piece goes to the fullest sequence that still has room."""
        while count:
            at = bisect.bisect_left(self.frees, length)
            if at == len(self.frees):
                a = min(self.capacity // length, count)
                self.open(((length, a),), count // a)
                count -= count // a * a
                continue
            free = self.frees[at]
            runs = self.by_free[free]
            first, n, items = runs.pop()
            if not runs:
                del self.by_free[free], self.frees[at]
            a = min(free // length, count)
            take = min(n, count // a)
            if take < n:
                self.add(free, (first + take, n - take, items))
            self.add(free - a * length, (first, take, (*items, (length, a))))
            count -= take * a


def _filled(counts: np.ndarray, classes: list[list[int]], left: dict[int, int], lengths: list[int], capacity: int) -> tuple[tuple[int, int], ...]:
    """One sequence after a configuration: pieces of its classes but the last, and for the rest whatever fits best; () if a class is used up.

    A class stands for its largest length, so its pieces leave room; the last ones are chosen to close it.
    """
    items: dict[int, int] = {}
    used = np.flatnonzero(counts)[::-1]
    wanted = [(g, int(counts[g])) for g in used]
    wanted[-1] = (wanted[-1][0], wanted[-1][1] - 1)
    room = capacity
    for g, need in wanted:
        for n in reversed(classes[g]):
            if need and (k := min(need, left.get(n, 0))):
                items[n] = items.get(n, 0) + k
                room -= n * k
                need -= k
        if need:
            return ()
    while (at := bisect.bisect_right(lengths, room)) > 0:
        n = next((n for n in reversed(lengths[max(0, at - 8) : at]) if left[n] > items.get(n, 0)), None)
        if n is None:
            break
        items[n] = items.get(n, 0) + 1
        room -= n
    return tuple(sorted(items.items(), reverse=True))


def _rounded(program: list[tuple[np.ndarray, float]], share: float, classes: list[list[int]], histogram: dict[int, int], capacity: int) -> _Runs:
    """Whole sequences for a share of the program's amounts, then best fit for what is left."""
    runs = _Runs(capacity)
    left = {n: c for n, c in histogram.items() if c}
    if capacity in left:
        runs.open(((capacity, 1),), left.pop(capacity))
    lengths = sorted(left)
    for counts, amount in program:
        wanted = int(amount * share)
        while wanted > 0 and (items := _filled(counts, classes, left, lengths, capacity)):
            times = min(wanted, *(left[n] // k for n, k in items))
            runs.open(items, times)
            for n, k in items:
                left[n] -= k * times
                if not left[n]:
                    del lengths[bisect.bisect_left(lengths, n)]
            wanted -= times
    for n in sorted(left, reverse=True):
        if left[n]:
            runs.fit(n, left[n])
    return runs


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """(length, lo, hi, copies, first, place): the pieces of a length with ranks lo to hi go, `copies` to a sequence, to sequences from `first` on.

    Lengths over `LARGE` form classes of near equal mass; the linear program runs on the classes' largest
    lengths; each configuration is rounded down and filled with actual pieces. Whatever rounding leaves goes
    by best fit, longest first, into the gaps.
    """
    left = {n: c for n, c in histogram.items() if c and n != capacity}
    large = sorted(n for n in left if n > min(LARGE, capacity // 16))
    classes: list[list[int]] = [[] for _ in range(CLASSES)]
    program: list[tuple[np.ndarray, float]] = []
    if large:
        mass = np.cumsum([n * left[n] for n in large], dtype=float)
        for n, m in zip(large, mass, strict=True):
            classes[min(CLASSES - 1, int(m / mass[-1] * CLASSES))].append(n)
        classes = [c for c in classes if c]
        sizes = np.array([c[-1] for c in classes])
        demand = np.array([sum(left[n] for n in c) for c in classes], float)
        program = sorted(configuration_program(sizes, demand, capacity), key=lambda x: -x[1])
    # the share of each amount that is rounded to whole sequences; the fewest sequences win
    runs = min((_rounded(program, share, classes, histogram, capacity) for share in SHARES), key=lambda r: r.next_id)
    given: dict[int, int] = {}
    rows = []
    for at in sorted((r for group in runs.by_free.values() for r in group), key=lambda r: r[0]):
        first, count, items = at
        place = 0
        for n, k in items:
            lo = given.get(n, 0)
            given[n] = lo + k * count
            rows.append((n, lo, lo + k * count, k, first, place))
            place += n * k
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "copies", "first", "place"]).sort_values(["length", "lo"], ignore_index=True)


def _seated(table: pd.DataFrame):
    shift = np.int64(48)
    keys = (table["length"].to_numpy(np.int64) << shift) + table["lo"].to_numpy(np.int64)
    columns = {c: table[c].to_numpy(np.int64) for c in ("lo", "copies", "first", "place")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            nth = rank - columns["lo"][at]
            copies = columns["copies"][at]
            seats = [columns["first"][at] + nth // copies, columns["place"][at] + nth % copies * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, seats)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text counts as empty and
    gives one piece that holds the end id only. Only documents over `capacity` are cut. Repeated rows are
    packed each for itself; an empty table gives no rows; extra columns are not read. The driver sees the
    histogram of lengths (at most `capacity` rows); pieces find their seats by their rank in a length.
    """
    pieces = cut_lineage(token_pieces(documents, tokenizer, capacity))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = pack_histogram(histogram, capacity)
    return ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank").mapInArrow(_seated(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
