"""Exact deduplication by two passes over a Bloom filter."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, releasing, whole_text

BLOCK_BITS = 4096
PROBES = 4
BITS_A_ROW = 16
MAX_BITS = 1 << 28
MOST_PARTS = 16
MERGED_ROWS = 500_000
LARGE_GROUP, MOST_LARGE = 1_000, 50_000


def _slots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its probes there: the same arithmetic as `_probe`."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    return block.astype(np.int64), np.stack([((hashes >> np.uint64(12 * k if k < 3 else 28)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in range(PROBES)])


def _probe(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, 12 * k if k < 3 else 28).bitwiseAND(F.lit(BLOCK_BITS - 1))


def _counted(blocks: int):
    """How often, once or more, the rows of a task touch each slot. Memory and output follow the rows, not the filter."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, often, waiting, rows = np.zeros(0, np.int64), np.zeros(0, bool), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_, n = np.unique(np.concatenate([slot, *waiting]), return_counts=True)
            again = n > 1
            again[np.searchsorted(all_, slot[often])] = True
            return all_, again

        for batch in batches:
            block, slots = _slots(batch["h"].to_numpy(np.int64).view(np.uint64), blocks)
            # a row counts once a slot, so its own probes must not raise one slot twice
            slots = np.sort(slots, axis=0)
            fresh = np.vstack([np.ones((1, slots.shape[1]), bool), slots[1:] != slots[:-1]])
            waiting.append((block[None, :] * BLOCK_BITS + slots)[fresh])
            rows += len(block)
            if rows >= MERGED_ROWS:
                (slot, often), waiting, rows = merged(), [], 0
        slot, often = merged()
        block = slot // BLOCK_BITS
        used, first = np.unique(block, return_index=True)
        ends = np.r_[first[1:], len(slot)]
        for at in range(0, len(used), 4096):
            pages = [(_page((slot[a:b] % BLOCK_BITS)), _page(slot[a:b][often[a:b]] % BLOCK_BITS)) for a, b in zip(first[at : at + 4096], ends[at : at + 4096], strict=True)]
            yield pd.DataFrame({"block": used[at : at + 4096], "once": [p for p, _ in pages], "twice": [p for _, p in pages]})

    return run


def _page(slots: np.ndarray) -> bytes:
    """Slots of a block: a few as two bytes each, many as bits."""
    if len(slots) < BLOCK_BITS // 16:
        return slots.astype(np.uint16).tobytes()
    bits = np.zeros(BLOCK_BITS, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def _bits(page: bytes) -> np.ndarray:
    if len(page) == BLOCK_BITS // 8:
        return np.unpackbits(np.frombuffer(page, np.uint8)).astype(bool)
    bits = np.zeros(BLOCK_BITS, bool)
    bits[np.frombuffer(page, np.uint16)] = True
    return bits


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the pages of one block after another (rows come sorted by block)."""
    at, once, twice = -1, np.zeros(0, bool), np.zeros(0, bool)

    def page() -> pd.DataFrame:
        return pd.DataFrame({"block": [at], "words": [np.packbits(twice, bitorder="little").view(np.int64).tolist()]})

    for batch in batches:
        for block, a, b in zip(batch["block"], batch["once"], batch["twice"], strict=True):
            if block != at:
                if at >= 0 and twice.any():
                    yield page()
                at, once, twice = block, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            a = _bits(a)
            twice |= _bits(b) | (once & a)
            once |= a
    if at >= 0 and twice.any():
        yield page()


def repeat_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """First pass over the column `h`: (block, words) with the slots touched at least twice. The tasks' pages of a block meet and add up."""
    pages = hashes.mapInPandas(_counted(blocks), "block long, once binary, twice binary")
    return pages.repartition(F.col("block")).sortWithinPartitions("block").mapInPandas(_merged, "block long, words array<long>")


def with_repeats(df: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Columns `row` (a struct of all columns) and `maybe`: false only where no other row has the same text.

    The filter has `BITS_A_ROW` bits a row. Its blocks come in parts of at most `max_bits`, so that each can
    be broadcast at any input size (32 MiB at most); the second pass reads the rows once for each part and
    takes those whose blocks the part has. From `MOST_PARTS` parts on a filter grows no more: it then lets
    more unique rows shuffle, and changes no result.
    """
    hashed = df.select(F.struct("*").alias("row"), F.xxhash64(whole_text()).alias("h"))
    wanted = max(1, (1 << math.ceil(math.log2(max(df.count(), 1) * BITS_A_ROW))) // BLOCK_BITS)
    each = max(1, min(wanted, max_bits // BLOCK_BITS))
    parts = min(wanted // each, MOST_PARTS)
    found = repeat_filter(hashed.select("h"), each * parts)
    if parts > 1:
        found = cut_lineage(found)
    placed = hashed.withColumn("block", F.pmod(F.shiftrightunsigned("h", 40), F.lit(each * parts)))
    hit = F.lit(True)
    for k in range(PROBES):
        word = F.element_at("words", (F.shiftright(_probe(F.col("h"), k), 6) + 1).cast("int"))
        bit = F.expr(f"shiftleft(1L, cast(63 & shiftrightunsigned(h, {12 * k if k < 3 else 28}) as int))")
        hit = hit & (word.bitwiseAND(bit) != 0)
    out = []
    for part in range(parts):
        inside = (F.col("block") >= part * each) & (F.col("block") < (part + 1) * each)
        mine, pages = (placed, found) if parts == 1 else (placed.where(inside), found.where(inside))
        out.append(mine.join(F.broadcast(pages), "block", "left").select("row", F.coalesce(hit, F.lit(False)).alias("maybe")))
    return functools.reduce(DataFrame.unionByName, out)


def exact_dedup(documents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. Of equal texts the largest doc_id
    stays (null ids below all others). Of rows that repeat both id and text, one stays. An empty table
    gives no rows; other columns are not read. Documents whose hash the filter saw once never shuffle.
    """
    seen = with_repeats(documents.select("doc_id", "text"), max_bits)
    seen = seen.select(F.col("row.doc_id").alias("doc_id"), "maybe", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))
    alone = seen.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    same = cut_lineage(seen.where("maybe").select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("n")))
    groups = same.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "n")).alias("best"), F.count("*").alias("group_size"))
    # groups beyond this size are few, whatever the input, and their rows stay where they are
    large = max(LARGE_GROUP, same.count() // MOST_LARGE)
    hot = cut_lineage(groups.where(F.col("group_size") > large))
    rows = same.join(F.broadcast(hot), "text_sha256").unionByName(same.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(groups, "text_sha256"))
    return alone.unionByName(rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("n") == F.col("best.n")).alias("kept"), "text_sha256"))


def drop_exact_copies(documents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, with all their columns; only possible repeats shuffle."""
    seen = with_repeats(documents, max_bits)
    alone = seen.where(~F.col("maybe")).select("row.*")
    maybe = seen.where("maybe").select("row", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("sha"), F.col("row.doc_id").alias("id"))
    best = maybe.groupBy("sha").agg(F.max("id").alias("keep")).withColumnRenamed("sha", "best_sha")
    # of a group, only rows with the largest id go on: one, or more where a row repeats whole
    stay = maybe.join(best, (F.col("sha") == F.col("best_sha")) & F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    return alone.unionByName(stay.dropDuplicates(["sha"]).select("row.*"))
