"""Windows of files too large for one task: many tasks cut the lines of one file into the chunks that `WindowChunker` makes of the whole text.

Where a window begins depends on the one before it, but only on that one. So each block of some million
characters says, for every line at which a window may enter it, at which line the windows leave it; these steps form a chain over the
blocks, which `reachable` follows in doubling jumps; then each block knows its entry and cuts its own windows. A
window reaches less than its size into the next block, so each block also gets the first lines of that one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import SPACES, content_hash, py_strip
from strandline.operators.chunk import WindowChunker
from strandline.operators.lineage import reachable
from strandline.sources.scratch import staged

BLOCK = 1 << 22
BLOCK_CHUNKS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("nth", pa.int64()), ("again", pa.int64()), ("text", pa.string())])
STEPS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("leaves", pa.int64())])


def read_lines(spark: SparkSession, paths: str | list[str], normalized: bool = True) -> DataFrame:
    """(path, part, place, text): the lines of text files, which Spark splits over tasks whatever their size.

    A part is one split of a file, and place orders the lines in it. `normalized` gives the lines of the text
    that `normalize` makes with its default steps; otherwise only line feeds end lines and nothing is trimmed.
    """
    rows = (spark.read if normalized else spark.read.option("lineSep", "\n")).text(paths)
    text = F.rtrim("value", F.lit(SPACES)) if normalized else F.col("value")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place"), text.alias("text"))


def stripped_lines(lines: DataFrame, largest: int) -> DataFrame:
    """Lines of the stripped files: path, line (from 0), before (characters ahead of it), size (with its line feed), text and whether the file is `short`.

    Counts and sums run inside parts, then over one row for each part, so no task sees a whole file. A null text is an
    empty line; files of nothing but white space have no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = lines.where("path is not null").select("path", "part", "place", text.alias("text")).withColumn("size", F.length("text").cast("long") + 1)
    order = Window.partitionBy("path", "part").orderBy("place")
    rows = rows.withColumn("line", F.row_number().over(order).cast("long") - 1)
    rows = rows.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    filled = py_strip(F.col("text")) != ""
    lead = F.col("size") - 1 - F.length(F.ltrim("text", F.lit(SPACES)))
    end = F.col("before") + F.length(F.rtrim("text", F.lit(SPACES)))
    parts = rows.groupBy("path", "part").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("chars"),
        F.min(F.when(filled, F.struct("line", (F.col("before") + lead).alias("at")))).alias("first"),
        F.max(F.when(filled, F.struct("line", end.alias("at")))).alias("last"),
    )
    whole = Window.partitionBy("path")
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "part", "first", "last", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "chars")])

    def moved(edge: str):
        return F.when(F.col(edge).isNotNull(), F.struct((F.col(f"{edge}.line") + F.col("n_ahead")).alias("line"), (F.col(f"{edge}.at") + F.col("chars_ahead")).alias("at")))

    parts = parts.select("path", "part", "n_ahead", "chars_ahead", F.min(moved("first")).over(whole).alias("first"), F.max(moved("last")).over(whole).alias("last"))
    at = F.col("line") + F.col("n_ahead")
    rows = rows.join(parts.where("first is not null"), ["path", "part"]).where(at.between(F.col("first.line"), F.col("last.line")))
    text = F.when(at == F.col("first.line"), F.ltrim("text", F.lit(SPACES))).otherwise(F.col("text"))
    text = F.when(at == F.col("last.line"), F.rtrim(text, F.lit(SPACES))).otherwise(text)
    before = F.greatest(F.col("before") + F.col("chars_ahead") - F.col("first.at"), F.lit(0))
    short = F.col("last.at") - F.col("first.at") <= largest
    rows = rows.select("path", (at - F.col("first.line")).alias("line"), before.alias("before"), text.alias("text"), short.alias("short"))
    return rows.withColumn("size", F.length("text").cast("long") + 1)


def following(before: np.ndarray, size: np.ndarray, largest: int, overlap: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """For a window that begins at each of these lines: where it ends and where the next one begins, as places in the arrays."""
    ends, at = before + size, np.arange(len(before))
    end = np.maximum(at + 1, np.searchsorted(ends, before + largest + 1, "right"))
    again = np.clip(np.searchsorted(ends, ends[end - 1] - overlap, "left"), at, end) + 1
    return end, np.where((at < again) & (again < end) & (not short), again, end)


def chunk_lines(lines: DataFrame, chunker: WindowChunker, block: int = BLOCK) -> DataFrame:
    """The rows of `chunk_files` with this chunker for files that come as lines (path, part, place, text) in the order of part and place.

    A task holds one part or one block at a time, and one line at least. Further columns are left out.
    """
    largest, overlap = chunker.largest, chunker.overlap
    # with much overlap every character stands in many windows, which a block must hold together
    copies = -(-largest // max(largest - overlap, 1))
    span = max(block // copies, largest + 2)
    rows = staged(stripped_lines(lines, largest), "lines")
    own = F.floor(F.col("before") / span).cast("long")
    blocks = F.when((own > 0) & (F.col("before") - own * span <= largest), F.array(own, own - 1)).otherwise(F.array(own))

    def spread(*columns: str) -> DataFrame:
        return rows.select("path", "line", "before", "size", "short", *columns, F.explode(blocks).alias("block"))

    def ordered(table: pa.Table) -> tuple[pa.Table, int, int, np.ndarray, np.ndarray]:
        table = table.sort_by("line")
        before, size = (table[c].to_numpy() for c in ("before", "size"))
        number = table["block"][0].as_py()
        end, after = following(before, size, largest, overlap, table["short"][0].as_py())
        return table, number, int(np.searchsorted(before, (number + 1) * span)), end, after

    def steps(table: pa.Table) -> pa.Table:
        table, number, mine, _, after = ordered(table)
        if not mine:
            return STEPS.empty_table()
        leaves = after[:mine].copy()
        while (inside := leaves < mine).any():
            leaves[inside] = leaves[leaves[inside]]
        line, before = table["line"].to_numpy(), table["before"].to_numpy()[:mine]
        # windows enter where the last one can end, or at the first line after a long one
        enter = np.flatnonzero((before - number * span <= largest) | (np.arange(mine) == 0))
        return pa.table([pa.array([table["path"][0].as_py()] * len(enter), pa.string()), pa.array(np.full(len(enter), number)), pa.array(line[enter]), pa.array(line[0] + leaves[enter])], schema=STEPS)

    def cut(table: pa.Table) -> pa.Table:
        table, number, mine, end, after = ordered(table)
        texts, first, path = table["text"].to_pylist(), table["line"][0].as_py(), table["path"][0].as_py()
        at, seen, found = table["entry"][0].as_py() - first, {}, []
        while at < mine:
            if text := "\n".join(texts[at : end[at]]).strip():
                seen[text] = seen.get(text, -1) + 1
                found.append((path, number, first + at, len(found), seen[text], text))
            at = int(after[at])
        columns = zip(*found, strict=True) if found else [[]] * len(BLOCK_CHUNKS)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, BLOCK_CHUNKS, strict=True)], schema=BLOCK_CHUNKS)

    links = staged(spread().groupBy("path", "block").applyInArrow(steps, "path string, block long, line long, leaves long"), "steps")
    chain = links.select(F.struct("path", "line").alias("commit_id"), F.struct("path", F.col("leaves").alias("line")).alias("parent_id"))
    begin = rows.where("line = 0").select(F.struct("path", "line").alias("start"))
    visited = reachable(chain, begin).select("commit_id.path", "commit_id.line")
    entries = links.join(visited, ["path", "line"]).select("path", "block", F.col("line").alias("entry"))
    whole = spread("text").join(entries, ["path", "block"])
    chunks = staged(whole.groupBy("path", "block").applyInArrow(cut, "path string, block long, line long, nth long, again long, text string").withColumn("hash", content_hash(F.col("text"))), "chunks")

    def ahead(*keys: str) -> DataFrame:
        """How many chunks with the same keys earlier blocks of the file hold."""
        order = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = chunks.groupBy(*keys, "block").agg(F.count("*").alias("n"))
        return counts.select(*keys, "block", F.sum("n").over(order).alias("ahead_" + keys[-1])).where(F.col("ahead_" + keys[-1]) > 0)

    rows = chunks.join(ahead("path"), ["path", "block"], "left").join(ahead("path", "hash"), ["path", "hash", "block"], "left")
    pos, dup = (F.col(c) + F.coalesce(a, F.lit(0)) for c, a in (("nth", "ahead_path"), ("again", "ahead_hash")))
    kind = F.when(F.col("line") == 0, "parent").otherwise("child")
    return rows.select("path", pos.cast("int").alias("pos"), kind.alias("chunk_type"), F.lit("").alias("heading_path"), "text", dup.cast("int").alias("dup_index"))
