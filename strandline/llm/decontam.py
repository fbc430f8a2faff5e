"""Benchmark decontamination: CGK embedding and bit sampling over item-sized windows, then exact edit distance."""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import kept_by_worker, releasing, small_batches
from strandline.llm.near_dup import BASE, mix

ALLOWED = 0.15  # share of edits up to which a part of a text counts as a leak
UNCHANGED = 18  # shorter items must occur as they are
WIDTHS = (32, 24, 16, 8)  # letters of a window: the largest that the item has; shorter items are windows themselves
WALKS = 2
SAMPLED = 12  # places of a sample from a window of 32 letters, fewer from shorter ones
FEW_FROM = 80  # letters from which an item has so many windows that some are little edited
FEW_WALKS, FEW_TIMES, FEW_SAMPLED = 8, 6, 5  # walks, samples of each and places of each for the windows of shorter items
GATE_GRAMS = (4, 5)
GATE_STEP = 1.1  # shorter items go together by lengths that differ by less
WORST = 0.1  # share of unequal places, in the item's least edited windows, that the target recall is reckoned for
RECALL = 0.99
TWO_FROM = 25  # windows of an item from which two of them must be found
BLOCK_CHARS = 500_000
ITEM_CHARS = 1_000_000
MAP_BITS = (16, 24)
KNOWN = 20_000
WINDOW_ROWS = 100_000
MOST_HITS = 2_000_000
UNSPACED = 0x0E00  # from here on scripts may have no blanks between words
END = 1  # stands between texts, and past the end of a window


def fold_table() -> np.ndarray:
    """Lower-case letters and digits as they are, all else a blank, for the code points of the first plane."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (x := chr(c)).isalnum():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each closed by END, in lower case with single blanks between words; and where each begins."""
    codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = codes == 0
    codes = np.where(cut, END, np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes))
    codes = np.r_[np.uint32(END), codes, np.uint32(END)].astype(np.uint32)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    # a blank goes after another one, after a beginning and before an end
    keep[1:] = ~(blank[1:] & (blank[:-1] | (codes[:-1] == END)))
    codes = codes[keep]
    before_end = np.r_[codes[1:] == END, False] & (codes == 32)
    codes = codes[~before_end]
    return codes[1:], np.r_[0, np.flatnonzero(codes[1:] == END) + 1][: len(texts)]


def repetitions(worst: float = WORST, sampled: int = SAMPLED, recall: float = RECALL) -> int:
    """How many samples find an embedding with that share of unequal places with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - worst) ** sampled))


def _walks(width: int, few: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For windows of that width: the bit of each walk, step and code, and for each walk and sample its places, steps of the walk."""
    steps = 2 * width
    walks, times, sampled = (FEW_WALKS, FEW_TIMES, FEW_SAMPLED) if few else (WALKS, math.ceil(repetitions() / WALKS), min(steps, max(4, SAMPLED * width // WIDTHS[0])))
    numbers = np.arange(1, walks * steps * 256 + 1, dtype=np.uint64) * BASE
    bits = (mix(numbers) >> np.uint64(63)).astype(np.uint8).reshape(walks, steps, 256)
    bits[:, :, 0] = 0  # at the end of a text every walk stays
    draws = mix(np.arange(1, walks * times * steps + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(walks, times, steps)
    return bits, np.sort(np.argsort(draws, axis=2)[:, :, :sampled], axis=2)


def small_codes(codes: np.ndarray) -> np.ndarray:
    """One byte a code, END as 0: letters of one text seldom share one, and if so a window is found too often, never too seldom."""
    return np.where(codes == END, 0, codes % 255 + 1).astype(np.uint8)


def embedded_samples(small: np.ndarray, starts: np.ndarray, width: int, few: bool = False) -> np.ndarray:
    """Hashes (windows, repetitions) of sampled places of the CGK embeddings of the windows that begin at `starts`.

    A walk writes the code it stands on, two for every code of the window, and moves on or stays as a random
    bit of (walk, step, code) says: strings a few edits apart soon walk in step again, so their embeddings
    differ in few places. Each repetition samples some places; it finds a pair whose places there agree.
    """
    bits, places = kept_by_worker(("walks", width, few), lambda: _walks(width, few))
    walks, times = places.shape[:2]
    out = np.empty((walks * times, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for walk in range(walks):
            at = starts.astype(np.int64)
            own = out[walk * times : (walk + 1) * times]
            own[:] = mix(np.arange(walk * times + 1, (walk + 1) * times + 1, dtype=np.uint64) + np.uint64((width << 1 | few) << 32))[:, None]
            for step in range(int(places[walk].max()) + 1):
                code = small.take(at)
                for r in np.flatnonzero((places[walk] == step).any(axis=1)):
                    own[r] = own[r] * np.uint64(0xD1342543DE82EF95) + code
                at += bits[walk, step].take(code)
        out ^= out >> np.uint64(29)
        out *= BASE
    return out.T


def window_starts(codes: np.ndarray, width: int) -> np.ndarray:
    """Where windows begin: at words, and in scripts without blanks at one in four letters, by what stands there; with room for most of a window."""
    behind = np.r_[np.uint32(END), codes[:-1]]
    begins = (behind == 32) | (behind == END)
    unspaced = np.flatnonzero(codes >= UNSPACED)
    if len(unspaced):
        with np.errstate(over="ignore"):
            begins[unspaced[(mix(codes[unspaced].astype(np.uint64) * BASE + codes[unspaced + 1]) & np.uint64(3)) == 0]] = True
    starts = np.flatnonzero(begins & (codes != END))
    ends = np.flatnonzero(codes == END)
    left = ends[np.searchsorted(ends, starts)] - starts if len(starts) else starts
    return starts[left >= width - int(width * ALLOWED)]


Gate = tuple[list[tuple[np.ndarray, int]], int, int]  # per size of grams the known ones and how many must stand there; how far on and how far back


@dataclass
class Index:
    """Samples of the windows of one width: sorted hashes with item and offset, and a bit map of them that most windows of a text miss.

    For the windows of short items also the gates: where no gate is open, no short item can begin.
    """

    width: int
    few: bool
    hashes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    shift: np.uint64
    seen: np.ndarray
    gates: list[Gate]


@dataclass
class Items:
    """Benchmark items ready to be searched."""

    ids: np.ndarray
    codes: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    need: np.ndarray  # windows that must be found
    edits: np.ndarray
    index: list[Index]
    grams: list[np.ndarray]


def gate_places(small: np.ndarray) -> list[np.ndarray]:
    """For each size of `GATE_GRAMS` a number of 16 bits for every so many successive codes, at the first of them."""
    padded = np.r_[small, np.zeros(GATE_GRAMS[-1], np.uint8)].astype(np.uint16)
    out, sizes = np.zeros(len(small), np.uint16), []
    for j in range(GATE_GRAMS[-1]):
        out = out * np.uint16(0x9E35) + padded[j : j + len(small)] * np.uint16(0x6A5D)
        out = out ^ (out >> np.uint16(7))
        if j + 1 in GATE_GRAMS:
            sizes.append(out)
    return sizes


def _gates(places: list[np.ndarray], begin: np.ndarray, length: np.ndarray, edits: np.ndarray) -> list[Gate]:
    """Gates of short items, those of about one length together.

    An edit breaks `size` of an item's grams of that size at most, and edits shift what stands behind them no further
    than their number: a place around which fewer grams of the items stand is none where one of them begins.
    """
    out = []
    step = np.floor(np.log(np.maximum(length, 1)) / math.log(GATE_STEP)).astype(np.int64)
    for s in np.unique(step):
        mine = np.flatnonzero(step == s)
        tests = []
        for size, at in zip(GATE_GRAMS, places, strict=True):
            known = np.zeros(1 << 16, bool)
            for i in mine:
                known[at[begin[i] : begin[i] + max(0, length[i] - size + 1)]] = True
            tests.append((known, int((length[mine] - (size - 1) - size * edits[mine]).min())))
        out.append((tests, int((length[mine] + edits[mine]).max()), int(edits[mine].max())))
    return out


def open_gates(small: np.ndarray, starts: np.ndarray, gates: list[Gate]) -> np.ndarray:
    """The window starts that lie in an item that may begin where a gate is open."""
    places, some = gate_places(small), np.zeros(len(starts), bool)
    n = len(small)
    for tests, reach, edits in gates:
        open_ = np.ones(n, bool)
        for (known, fewest), own in zip(tests, places, strict=True):
            if fewest > 0:
                total = np.zeros(n + reach + edits + 1, np.int32)  # before, in and behind the text
                np.cumsum(known[own], dtype=np.int32, out=total[edits + 1 : edits + 1 + n])
                total[edits + 1 + n :] = total[edits + n]
                open_ &= total[edits + reach : edits + reach + n] - total[:n] >= fewest
        # the item begins `reach` letters before the window at most, and its edits behind it
        opened = np.r_[0, np.cumsum(open_, dtype=np.int32)]
        some |= opened[np.minimum(starts + edits + 1, n)] > opened[np.maximum(starts - reach, 0)]
    return starts[some]


def _likely(places: np.ndarray, found: np.ndarray, items: Items) -> np.ndarray:
    """The hits (item, start, offset) of short items around whose start enough of the item's own grams stand."""
    size, keep = GATE_GRAMS[0], np.zeros(len(found), bool)
    for i in np.unique(found[:, 0]).tolist():
        mine = np.flatnonzero(found[:, 0] == i)
        length, edits = int(items.length[i]), int(items.edits[i])
        known = np.zeros(1 << 16, bool)
        known[gate_places(small_codes(items.codes[items.begin[i] : items.begin[i] + length]))[0][: max(0, length - size + 1)]] = True
        starts, of = np.unique(found[mine, 1], return_inverse=True)
        counts = np.empty(len(starts), np.int64)
        for at in range(0, len(starts), 10_000):
            part = starts[at : at + 10_000, None] + np.arange(-edits, length + 2 * edits)
            inside = (part >= 0) & (part < len(places))
            counts[at : at + 10_000] = (known[places[np.clip(part, 0, len(places) - 1)]] & inside).sum(axis=1)
        keep[mine] = counts[of] >= length - (size - 1) - size * edits
    return found[keep]


def prepare(ids: list, texts: list[str], table: np.ndarray) -> Items:
    """Embeds the windows of all items; an item goes with the windows of the largest width that it has.

    Items under `FEW_FROM` letters, of which no window may be little edited, have more walks and shorter samples. Equal
    windows of an item count once: its first and its last place stand for them.
    """
    codes, begin = folded(texts, table)
    length = np.array([np.r_[begin[1:], len(codes)][i] - 1 - begin[i] for i in range(len(texts))], np.int64)
    some = length > 0
    ids_, begin, length = np.array(ids, object)[some], begin[some].astype(np.int64), length[some]
    edits = np.where(length < UNCHANGED, 0, (length * ALLOWED).astype(np.int64))
    kind = np.array([next((w for w in WIDTHS if w <= n), n) << 1 | (UNCHANGED <= n < FEW_FROM) for n in length.tolist()], np.int64)
    need = np.ones(len(begin), np.int64)
    small, index = small_codes(codes), []
    for k in np.unique(kind).tolist():
        w, few = k >> 1, bool(k & 1)
        mine = np.flatnonzero(kind == k)
        starts = window_starts(codes, w)
        item = np.searchsorted(begin, starts, side="right") - 1
        starts = np.union1d(starts[kind[item] == k], begin[mine])
        item = np.searchsorted(begin, starts, side="right") - 1
        samples = embedded_samples(small, starts, w, few)
        first = np.unique(np.c_[item.astype(np.uint64), samples[:, 0]], axis=0)[:, 0].astype(np.int64)
        if not few:
            need[mine] = np.where(np.bincount(first, minlength=len(begin))[mine] >= TWO_FROM, 2, 1)
        row = np.repeat(np.arange(len(starts)), samples.shape[1])
        hashes, item, offset = samples.ravel(), item[row], starts[row] - begin[item[row]]
        order = np.lexsort((offset, item, hashes))
        hashes, item, offset = hashes[order], item[order], offset[order]
        ends = np.r_[True, (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])]
        chosen = ends | np.r_[ends[1:], True]
        hashes, item, offset = hashes[chosen], item[chosen], offset[chosen]
        bits = min(max(int(16 * len(hashes)).bit_length(), MAP_BITS[0]), MAP_BITS[1])
        seen = np.zeros(1 << bits, bool)
        seen[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        index.append(Index(w, few, hashes, item, offset, np.uint64(64 - bits), seen, _gates(gate_places(small), begin[mine], length[mine], edits[mine]) if few else []))
    return Items(ids_, codes, begin, length, need, edits, index, [grams(codes[b : b + n]) for b, n in zip(begin, length, strict=True)])


def _hits(index: Index, starts: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """(item, start of the item, offset) of the windows at `starts` that share a sample with one of an item, each once."""
    row, column = np.nonzero(index.seen[(samples >> index.shift).astype(np.int64)])
    asked = samples[row, column]
    lo = np.searchsorted(index.hashes, asked, side="left")
    count = np.searchsorted(index.hashes, asked, side="right") - lo
    row, lo, count = row[count > 0], lo[count > 0], count[count > 0]
    out = [np.zeros((0, 3), np.int64)]
    # so many at a time that what many items share takes little room
    cuts = np.flatnonzero(np.diff(np.cumsum(count) // MOST_HITS)) + 1
    for r, l, c in zip(np.split(row, cuts), np.split(lo, cuts), np.split(count, cuts), strict=True):
        if len(r):
            total = np.cumsum(c)
            which = np.repeat(l - (total - c), c) + np.arange(total[-1])
            out.append(np.unique(np.c_[index.item[which], np.repeat(starts[r], c) - index.offset[which], index.offset[which]], axis=0))
    return np.concatenate(out)


def windows(codes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, start) of the places where windows of an item are found, enough of them on diagonals no further apart than its edits."""
    found = [np.zeros((0, 3), np.int64)]
    small = small_codes(codes)
    for index in items.index:
        starts = window_starts(codes, index.width)
        if index.few:
            starts = open_gates(small, starts, index.gates)
            places = gate_places(small)[0] if len(starts) else None
        for at in range(0, len(starts), WINDOW_ROWS):
            part = starts[at : at + WINDOW_ROWS]
            hits = _hits(index, part, embedded_samples(small, part, index.width, index.few))
            found.append(_likely(places, hits, items) if index.few and len(hits) else hits)
    item, start, offset = np.unique(np.concatenate(found), axis=0).T
    if not len(item):
        return item, start
    reach, shift = np.int64(1) << np.int64(40), np.int64(1) << np.int64(30)
    key = item * reach + start + shift
    # from one hit to the next the window must change: no run of one window, as in repeated words, counts twice
    changes = np.r_[0, np.cumsum(offset[1:] != offset[:-1])]
    stop = np.searchsorted(key, key + items.edits[item], side="right")
    enough = changes[stop - 1] - changes + 1 >= items.need[item]
    # every hit in reach of such a beginning marks a place of its own
    ahead = np.zeros(len(key) + 1, np.int64)
    np.add.at(ahead, np.flatnonzero(enough), 1)
    np.add.at(ahead, stop[enough], -1)
    pairs = np.unique(key[np.cumsum(ahead[:-1]) > 0])
    return pairs // reach, pairs % reach - shift


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of every three successive codes."""
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix((c[:-2] << np.uint64(42)) + (c[1:-1] << np.uint64(21)) + c[2:])


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and where that part ends (bit-parallel)."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        right = down | (~(d | up) & full)
        left = up & d
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right = right << 1 & full
        left = left << 1 & full
        up = left | (~(x | right) & full)
        down = right & x
        if score < best:
            best, end = score, j + 1
    return best, end


def leaks(texts: list[str], items: Items, table: np.ndarray, known: dict[tuple[int, bytes], tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, place in the folded text) for every item that a text holds, where it matches best.

    `known` keeps the distances of parts already compared: passages repeat.
    """
    best: dict[tuple[int, int], tuple[int, int]] = {}
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end])
            end += 1
        codes, begin = folded(texts[at:end], table)
        item, start = windows(codes, items)
        done: set[tuple[int, int, int]] = set()
        if len(item):
            doc = np.clip(np.searchsorted(begin, np.maximum(start, 0) + items.length[item] // 2, side="right") - 1, 0, len(begin) - 1)
            first, last = begin[doc], np.r_[begin[1:], len(codes)][doc] - 1
            # room for the item's edits on either side
            room = 2 * items.edits[item] + 1
            a, b = np.maximum(first, start - room), np.minimum(last, start + items.length[item] + room)
            for i in np.flatnonzero(b > a).tolist():
                n, k = int(item[i]), int(items.edits[item[i]])
                spot = (int(doc[i]), n, int(start[i]) // (k + 1))
                if spot in done:
                    continue
                done.add(spot)
                part = codes[a[i] : b[i]]
                key = (n, part.tobytes())
                if (match := known.get(key)) is None:
                    # an edit breaks three of the item's grams at most
                    if np.isin(items.grams[n], grams(part)).sum() < len(items.grams[n]) - 3 * k:
                        match = (k + 1, 0)
                    else:
                        match = best_match(items.codes[items.begin[n] : items.begin[n] + items.length[n]].tolist(), part.tolist())
                    if len(known) < KNOWN:
                        known[key] = match
                distance, stop = match
                pair = (at + int(doc[i]), n)
                found = (distance, max(0, int(a[i] - first[i]) + stop - int(items.length[n])))
                if distance <= k and found < best.get(pair, (distance + 1, 0)):
                    best[pair] = found
        at = end
    return [(*pair, *match) for pair, match in sorted(best.items())]


def _search(shared: Broadcast[bytes]):
    """A function from texts to their leaks, for one task: it keeps the distances of parts already compared."""
    table, items = fold_table(), pickle.loads(shared.value)
    known: dict[tuple[int, bytes], tuple[int, int]] = {}
    return items, lambda texts: leaks([(t or "").replace("\x00", " ") for t in texts], items, table, known)


def _searched(shared: Broadcast[bytes]):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, search = _search(shared)
        for batch in batches:
            if rows := search(batch.column(1).to_pylist()):
                text, item, distance, place = zip(*rows, strict=True)
                columns = [[int(items.ids[i]) for i in item], distance, [int(items.length[i]) for i in item], place]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "item_id", "distance", "item_chars", "place"])

    return run


def item_blocks(benchmark: DataFrame, block_chars: int = ITEM_CHARS) -> Iterator[Broadcast[bytes]]:
    """The items in blocks of about `block_chars` characters, whatever their number: each block may go to all tasks, pickled by value."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / block_chars))
    table = fold_table()
    for part in range(parts):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toPandas()
        texts = [t.replace("\x00", " ") for t in block["text"]]
        yield benchmark.sparkSession.sparkContext.broadcast(cloudpickle.dumps(prepare(block["item_id"].tolist(), texts, table)))


def find_leaks(documents: DataFrame, benchmark: DataFrame, block_chars: int = ITEM_CHARS) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, distance, item_chars, place.

    Compared are lower-case letters and digits, with one blank for whatever stands between. A part of the
    text within 15 % edits of the item counts as a leak; distance is the least such edit distance, and place
    where that part begins in the folded text. Windows of the items are found by samples of their CGK
    embeddings, as many as the target recall of 0.99 asks for; what is found is compared exactly. Items of 18 to 79
    characters, which have few windows, are asked for by more and shorter samples, wherever enough of their grams
    stand. Items of fewer than 18 characters must occur unchanged. Null, empty and letterless texts and items hold and leak
    nothing; items without id are not searched. Repeated documents give repeated rows; extra columns are not
    read.

    Documents never shuffle: each block of items, of bounded size, is searched for in one pass over them.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, item_chars long, place long"
    found = [rows.mapInArrow(_searched(block), schema) for block in item_blocks(benchmark, block_chars)]
    return functools.reduce(DataFrame.unionByName, found)


def drop_leaking(documents: DataFrame, benchmark: DataFrame, block_chars: int = ITEM_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; none shuffles and none is matched by its id."""
    return functools.reduce(_without, item_blocks(benchmark, block_chars), documents)


def _without(documents: DataFrame, block: Broadcast[bytes]) -> DataFrame:
    small_batches(documents.sparkSession)
    at = documents.columns.index("text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, search = _search(block)
        for batch in batches:
            found = {text for text, *_ in search(batch.column(at).to_pylist())}
            yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
