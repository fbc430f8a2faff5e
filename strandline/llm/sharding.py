"""Longest-processing-time scheduling of groups of equal texts over shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, ranked, whole_text

SHARDS = 24
EXACT_BITS = 12


def size_class(size: Column) -> Column:
    """The size with its first 12 binary digits only: at most some 100,000 classes at any input size, each within 0.05 %."""
    shift = F.greatest(F.lit(0), F.ceil(F.log2(size.cast("double") + 1)).cast("int") - EXACT_BITS)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(size / unit).cast("long") * unit


def longest_first(classes: Sequence[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """Places the groups of each (class, number of groups, bytes), largest class first, each on the least-loaded shard.

    Gives for each class the first ranks and the shards that take the ranks from there on. Many groups
    of one size go as the heap would place them one by one: level by level, the rest through the heap.
    """
    load = np.zeros(shards)
    plan = []
    for size_key, count, total in sorted(classes, reverse=True):
        each = total / count
        got = np.zeros(shards, np.int64)
        if count > 4 * shards and each > 0:
            order = np.sort(load)
            filled = (np.cumsum(order) + count * each) / np.arange(1, shards + 1)
            level = filled[max(int(np.cumprod(order < filled).sum()) - 1, 0)]
            got = np.maximum(0, np.floor((level - load) / each)).astype(np.int64)
            while got.sum() > count:
                got[got.argmax()] -= 1
        heap = [(x, s) for s, x in enumerate(load + got * each)]
        heapq.heapify(heap)
        for _ in range(count - int(got.sum())):
            least, shard = heap[0]
            got[shard] += 1
            heapq.heapreplace(heap, (least + each, shard))
        load = load + got * each
        taken = np.flatnonzero(got)
        plan.append((int(size_key), (np.cumsum(got[taken]) - got[taken]).tolist(), taken.tolist()))
    return plan


def _placed(plan: tuple[np.ndarray, np.ndarray, np.ndarray]):
    keys, starts, shards = plan

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        combined = np.rec.fromarrays([keys, starts])
        for batch in batches:
            asked = np.rec.fromarrays([batch["class"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)], dtype=combined.dtype)
            at = np.searchsorted(combined, asked, side="right") - 1
            yield pd.DataFrame({"group": batch["group"], "shard": shards[at]})

    return run


def shard_groups(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(group, shard) for rows (group, size): the groups in order of size, each on the least-loaded shard.

    The driver sees only the histogram of group sizes. A group's place among those of its class comes
    from a two-level rank.
    """
    groups = cut_lineage(rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes"))))
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
    plan = sorted(longest_first([tuple(r) for r in histogram], shards))
    keys = np.repeat([k for k, _, _ in plan] or [0], [len(s) for _, s, _ in plan] or [1]).astype(np.int64)
    starts = np.array([x for _, s, _ in plan for x in s] or [0], np.int64)
    where = np.array([x for _, _, s in plan for x in s] or [0], np.int32)
    return ranked(groups, "class", ["group"], "rank").select("group", "class", "rank").mapInPandas(_placed((keys, starts, where)), "group long, shard int")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Puts every document into a shard so that shards are near equal in bytes and equal texts stay together.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text counts as empty (size 8)
    and so shares the group of empty texts. Slots run from 0 in each shard without gaps; rows that repeat
    whole get slots of their own. An empty table gives no rows; extra columns are not read. A group is
    known by a 64-bit hash of its text: should two texts share one, they only share a shard.
    """
    text = whole_text()
    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("group"))
    # the one large group may hold a third of all rows: AQE splits its side of the join
    placed = cut_lineage(rows.join(shard_groups(rows.select("group", "size"), shards), "group").drop("group"))
    return ranked(placed, "shard", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
