"""How the expected rows of changed files meet the rows that the index has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.model import TEXT_FIELDS

# An update leaves these as they were.
KEPT_ON_UPDATE = ("content_hash", "chunk_schema_id")


def classified(expected: DataFrame, index: DataFrame) -> DataFrame:
    """The expected rows with op: `update` if the index has their id, else `add`."""
    known = index.select(F.col("id").alias("known"))
    return expected.join(known, expected["id"] == F.col("known"), "left").withColumn("op", F.when(F.col("known").isNull(), "add").otherwise("update")).drop("known")


def new_rows(expected: DataFrame, index: DataFrame) -> DataFrame:
    """Expected rows whose id the index lacks: only these are embedded."""
    return expected.join(index.select("id"), "id", "left_anti")


def upsert(index: DataFrame, rows: DataFrame, order: Column | None = None) -> DataFrame:
    """The index with these rows in the place of those with their ids; of several rows with one id the last by `order`.

    Without `order` it is the order in which the rows are read, which files and lists have but shuffled rows lack.
    """
    newest = Window.partitionBy("id").orderBy(F.desc("_at"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id() if order is None else order).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_at", "_n")
    return index.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def update(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with the fields of `rows` in its rows of the same ids; unknown ids do nothing, missing fields stay."""
    given = [c for c in rows.columns if c != "id"]
    named = rows.select(F.col("id").alias("_id"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in given])
    joined = index.join(named, F.col("id") == F.col("_id"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in index.columns])


def merged(index: DataFrame, staged_new: DataFrame, expected: DataFrame, processed: DataFrame) -> DataFrame:
    """The index after a sync: rows of processed paths give way to the expected ones.

    Ids that were there keep their embedding and the fields of `KEPT_ON_UPDATE`; all else on the paths is
    gone, whether marked by an older sync or deleted with its file. processed: (path), deleted ones too.
    """
    untouched = index.join(processed.select("path"), "path", "left_anti")
    old = index.select(F.col("id"), *[F.col(c).alias(f"old_{c}") for c in (*KEPT_ON_UPDATE, "embedding")])
    kept = expected.join(old, "id").select(*[F.col(f"old_{c}").alias(c) if c in KEPT_ON_UPDATE else F.col(c) for c in TEXT_FIELDS], F.col("old_embedding").alias("embedding"))
    columns = [*TEXT_FIELDS, "embedding"]
    return untouched.select(*columns).unionByName(kept).unionByName(staged_new.select(*columns))
