"""Embedding stage: texts go to an embedder in batches, inside the tasks."""

from __future__ import annotations

import asyncio
import random
import time
from collections.abc import Awaitable, Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from strandline.functions.batches import PIECE_ROWS, in_pieces, releasing
from strandline.functions.text import estimated_tokens, hash_embedding
from strandline.model import EmbeddingError

# What tells an error that no retry mends.
PERMANENT_WORDS = ("invalid api key", "unauthorized", "authentication")
PERMANENT_CODES = (400, 401, 403, 404, 422)


class Embedder(Protocol):
    def id(self) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Vectors from the texts' SHA-256, without a model; `embed_rows` makes them by built-in functions."""

    def id(self) -> str:
        return "hash"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


EMBEDDERS: dict[str, Callable[[str], Embedder]] = {"hash": lambda model: HashEmbedder()}


def create_embedder(config: dict[str, Any]) -> Embedder:
    """The embedder for `provider` or `provider:model`; providers register in `EMBEDDERS`, an unknown one is an error."""
    name = str((config.get("embedder") or {}).get("id"))
    provider, _, model = name.partition(":")
    if (make := EMBEDDERS.get(provider)) is None:
        raise EmbeddingError(f"unknown embedder {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return make(model)


def is_transient(error: BaseException) -> bool:
    """Whether a retry may help: unless the words or the status code of the error say that it cannot."""
    if any(word in str(error).lower() for word in PERMANENT_WORDS):
        return False
    for holder in (error, getattr(error, "response", None)):
        try:
            return int(holder.status_code) not in PERMANENT_CODES  # type: ignore[union-attr]
        except (AttributeError, TypeError, ValueError):
            continue
    return True


def _pause(attempt: int, longest: float) -> float:
    return min(longest, 2.0**attempt) * random.uniform(0.9, 1.0)


def with_retry(call: Callable[[], Any], retries: int = 3, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls again after transient errors, up to `retries` times, waiting 1 s to `longest`; the last error goes on."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as error:
            if attempt == retries or not is_transient(error):
                raise
            sleep(_pause(attempt, longest))
    raise AssertionError


async def with_retry_async(call: Callable[[], Awaitable[Any]], retries: int = 3, longest: float = 30.0) -> Any:
    for attempt in range(retries + 1):
        try:
            return await call()
        except Exception as error:
            if attempt == retries or not is_transient(error):
                raise
            await asyncio.sleep(_pause(attempt, longest))
    raise AssertionError


def embed_texts(embedder: Embedder, texts: list[str], batch_size: int = 64, max_concurrent: int = 1, retries: int = 3) -> tuple[list[list[float]], int]:
    """Vectors in the order of the texts, and the number of calls. Calls overlap only if the embedder can and may."""
    parts = [texts[i : i + batch_size] for i in range(0, len(texts), max(batch_size, 1))]
    if max_concurrent > 1 and hasattr(embedder, "async_embed"):

        async def everything() -> list[list[list[float]]]:
            gate = asyncio.Semaphore(max_concurrent)

            async def one(part: list[str]) -> list[list[float]]:
                async with gate:
                    return await with_retry_async(lambda: embedder.async_embed(part), retries)  # type: ignore[attr-defined]

            return await asyncio.gather(*(one(p) for p in parts))

        done = asyncio.run(everything())
    else:
        done = [with_retry(lambda p=p: embedder.embed(p), retries) for p in parts]
    for part, vectors in zip(parts, done, strict=True):
        if len(part) != len(vectors):
            raise EmbeddingError(f"{len(vectors)} vectors for {len(part)} texts")
    return [v for vectors in done for v in vectors], len(parts)


def embed_rows(rows: DataFrame, embedder: Embedder, batch_size: int = 64, max_concurrent: int = 1, retries: int = 3) -> DataFrame:
    """Adds embedding (array<float>) and calls (the calls made for a batch, at its first row) from the column text.

    Write the result before using it twice: read again, it would call the embedder again. No more than
    `max_concurrent` calls run at once in a task; coalesce the rows to bound the calls of all tasks.
    """
    if type(embedder) is HashEmbedder:
        return rows.withColumn("embedding", hash_embedding(F.col("text")).cast("array<float>")).withColumn("calls", F.lit(0).cast("long"))
    schema = StructType([f for f in rows.schema if f.name != "embedding"] + [StructField("embedding", ArrayType(FloatType())), StructField("calls", LongType())])
    source = rows.drop("embedding")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, max(PIECE_ROWS, batch_size * max_concurrent)):
            texts = batch["text"].to_pylist()
            if not texts:
                continue
            vectors, calls = embed_texts(embedder, texts, batch_size, max_concurrent, retries)
            added = [pa.array(vectors, pa.list_(pa.float32())), pa.array([calls] + [0] * (len(texts) - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *added], schema=arrow)

    return source.mapInArrow(releasing(run), schema)


def embedding_stats(staged: DataFrame) -> DataFrame:
    """One row: calls, texts and estimated tokens of staged rows."""
    return staged.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count("*").alias("texts"), F.coalesce(F.sum(estimated_tokens(F.col("text"))), F.lit(0)).alias("tokens"))
