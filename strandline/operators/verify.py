"""The index against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_checks(index: DataFrame, expected: DataFrame, checked: DataFrame) -> DataFrame:
    """One row for each path of `checked` (path): missing and stale ids, counted and listed in order.

    index and expected: (path, id). Missing are expected ids without a row, stale ones rows of the path
    that nothing expects.
    """
    have = index.select("path", "id", F.lit(True).alias("have"))
    want = expected.select("path", "id", F.lit(True).alias("want"))
    both = have.join(want, ["path", "id"], "full_outer").join(checked.select("path"), "path", "left_semi")
    missing, stale = F.col("have").isNull(), F.col("want").isNull()
    found = both.groupBy("path").agg(
        F.count_if(missing).alias("missing_count"),
        F.count_if(stale).alias("stale_count"),
        # a path has the chunks of one file, so its lists are bounded
        F.array_sort(F.collect_set(F.when(missing, F.col("id")))).alias("missing_ids"),
        F.array_sort(F.collect_set(F.when(stale, F.col("id")))).alias("stale_ids"),
    )
    rows = checked.select("path").join(found, "path", "left")
    count = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("missing_count", "stale_count")}
    ids = {c: F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("missing_ids", "stale_ids")}
    issues = F.filter(F.array(F.when(F.col("missing_count") > 0, "MISSING"), F.when(F.col("stale_count") > 0, "STALE")), lambda x: x.isNotNull())
    return rows.select("path", *count.values(), *ids.values()).withColumn("issues", issues).withColumn("status", F.when(F.size("issues") > 0, "FAIL").otherwise("OK"))


def stale_deleted(index: DataFrame, expected_paths: DataFrame, ignored: Column) -> DataFrame:
    """(path, stale_count) of indexed paths that the source no longer has and no rule leaves out."""
    gone = index.where(F.length("path") > 0).join(expected_paths.select("path"), "path", "left_anti").where(~ignored)
    return gone.groupBy("path").agg(F.count("*").alias("stale_count"))


def ignored_stale(index: DataFrame, ignored: Column) -> DataFrame:
    """Indexed paths that the rules leave out."""
    return index.where(F.length("path") > 0).where(ignored).select("path").distinct()
