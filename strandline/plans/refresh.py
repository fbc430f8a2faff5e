"""One step of the index from the files that changed: chunk, embed what is new, merge, commit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.predicates import of_ref
from strandline.operators.chunk import Chunker, expected_rows
from strandline.operators.embed import Embedder, embed_rows, embedding_stats
from strandline.operators.merge import merged, new_rows
from strandline.sources.table import IndexTable


FOLD_AT = 0.3  # share of rows outside the buckets or marked as deleted from which a refresh folds them


@dataclass(frozen=True)
class Counts:
    added: int = 0
    updated: int = 0
    deleted: int = 0
    calls: int = 0
    texts: int = 0
    tokens: int = 0


def refresh(
    table: IndexTable,
    processed: DataFrame,
    files: DataFrame,
    chunker: Chunker,
    embedder: Embedder,
    repo_id: str,
    ref: str,
    commit: str,
    token: str,
    normalize: dict[str, bool] | None = None,
    embedding: dict[str, Any] | None = None,
    full: bool = False,
    reembed: bool = False,
) -> Counts:
    """Brings the rows of the processed paths (path) to what the files (path, text) ask for; paths without a file lose theirs.

    With `full` all rows of the ref go first; with `reembed` those of the processed paths. The chunks and
    the embeddings of new ones are written once to a staging folder, so that no retry embeds twice. What is
    read and written otherwise follows the change: files that may hold the paths, marks of their old rows, and the new rows.
    """
    manifest = table.manifest()
    own = of_ref(repo_id, ref)
    staging = f"{table.path}/staging/{token}-{uuid.uuid4().hex[:8]}"
    spark = table.spark

    def staged(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{staging}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{staging}/{name}")

    try:
        paths = processed.select("path").distinct()
        if full:
            old = table.read(manifest=manifest).where(own)
        else:
            # rows of the processed paths alone, from files that may hold them
            near = table.files_of(paths.select(F.col("path").alias("value")), "path", manifest)
            old = staged(table.read(near, manifest, places=True).where(own).join(paths, "path", "left_semi"), "old")
        known = old.where(F.lit(False)) if full or reembed else old
        expected = staged(expected_rows(files, chunker, normalize, repo_id, ref, commit, token), "expected")
        fresh = staged(embed_rows(new_rows(expected, known), embedder, **(embedding or {})), "new")
        stats = embedding_stats(fresh).first()
        before = old.count()
        updated = 0 if full or reembed else expected.join(known.select("id"), "id", "left_semi").count()
        rows = merged(known.drop("_file", "_row"), fresh, expected, paths)
        if full:
            others = table.read(manifest=manifest).where(~F.coalesce(own, F.lit(False)))
            table.commit(rows.unionByName(others), manifest)
        else:
            after = table.change(rows, old.select("_file", "_row") if before else None, manifest)
            if table.debt(after) > FOLD_AT:
                table.compact(FOLD_AT)
        calls = int(stats["calls"]) or (int(stats["texts"] > 0))
        return Counts(int(stats["texts"]), updated, before - updated, calls, int(stats["texts"]), int(stats["tokens"]))
    finally:
        table.remove(staging)
