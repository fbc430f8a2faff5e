"""Histories as DataFrames: which commits a commit has behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.scratch import scratch_folder


def reachable(edges: DataFrame, starts: DataFrame, growth: int = 4) -> DataFrame:
    """(start, commit_id): of every start (start) itself and all commits that its parents lead to; edges: (commit_id, parent_id).

    Jumps double: after round r a jump is a way of 2^r steps, and what was reached are all commits within 2^r - 1
    steps, so a history of n commits in a row takes log2(n) rounds. Where many merges make jumps more than
    `growth` times as many as the steps, they stay as long as they are, and what follows are waves of such jumps: work
    and files stay bounded by the edges, and a wave passes 2^r generations. Each round is written once, so
    no plan grows with the rounds. Cycles end as well: nothing new is reached.
    """
    spark = edges.sparkSession
    folder, parts = scratch_folder(spark), []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    jumps = kept(edges.select(F.col("commit_id").alias("at"), F.col("parent_id").alias("to")).where("at is not null and to is not null").distinct(), "steps")
    limit = growth * jumps.count()
    new, doubling = starts.select("start", F.col("start").alias("commit_id")).where("start is not null").distinct(), True
    while True:
        new = kept(new, f"reached-{len(parts)}")
        parts.append(f"{folder}/reached-{len(parts)}")
        seen = spark.read.schema(new.schema).parquet(*parts)
        if len(parts) > 1:
            if new.isEmpty():
                return seen
            if doubling:
                longer = jumps.join(jumps.select(F.col("at").alias("to"), F.col("to").alias("further")), "to").select("at", F.col("further").alias("to")).distinct()
                longer = kept(longer, f"jumps-{len(parts)}")
                if doubling := longer.count() <= limit:
                    jumps = longer
        # while jumps double, all that was reached jumps; later only what the last wave reached
        front = (seen if doubling else new).withColumnRenamed("commit_id", "at")
        landed = front.join(jumps, "at").select("start", F.col("to").alias("commit_id")).distinct()
        new = landed.join(seen, ["start", "commit_id"], "left_anti")


def ahead(edges: DataFrame, since, until) -> DataFrame:
    """(commit_id) of the commits that `until` has behind it, itself included, and `since` has not."""
    starts = edges.sparkSession.createDataFrame([(since,), (until,)], f"start {edges.schema['commit_id'].dataType.simpleString()}")
    found = reachable(edges, starts)
    old = found.where(F.col("start") == F.lit(since)).select("commit_id")
    return found.where(F.col("start") == F.lit(until)).select("commit_id").join(old, "commit_id", "left_anti")
