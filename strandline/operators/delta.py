"""Change sets between snapshots, and what of them is to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.ignore import Rule, ignored, internal
from strandline.operators.rules import MANY, not_ignored, with_verdict
from strandline.sources.scratch import scratch_folder


def change_set(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(path, status): A for new paths, D for gone ones, M for those with other content; all A without an old snapshot.

    A rename is a D and an A.
    """
    if old is None:
        return new.select("path", F.lit("A").alias("status"))
    a = old.select("path", F.col("content_hash").alias("old_hash"), F.lit(1).alias("in_old"))
    b = new.select("path", F.col("content_hash").alias("new_hash"), F.lit(1).alias("in_new"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "D").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "M")
    return both.select("path", status.alias("status")).where(F.col("status").isNotNull())


def wanted(changes: DataFrame, rules: list[Rule]) -> DataFrame:
    """Without own and git files, and without ignored ones unless they are gone."""
    return not_ignored(changes.where(~internal(F.col("path"))), rules, F.col("status") == "D")


def readmitted(new: DataFrame, old_rules: list[Rule], new_rules: list[Rule]) -> DataFrame:
    """Paths that the old rules left out and the new ones let in."""
    path = F.col("path")
    paths = new.select("path").where(~internal(path))
    if len(old_rules) <= MANY:
        return not_ignored(paths.where(ignored(path, old_rules)), new_rules)
    return not_ignored(with_verdict(paths, old_rules, column="_was").where("_was").drop("_was"), new_rules)


def plan(old: DataFrame | None, new: DataFrame, new_rules: list[Rule], old_rules: list[Rule] | None = None) -> DataFrame:
    """(path, status), one row a path: the wanted changes, and as A what changed rules readmit.

    `old_rules` are given only if the ignore file itself changed.
    """
    return planned(change_set(old, new), new, new_rules, old_rules)


def planned(changes: DataFrame, new: DataFrame, new_rules: list[Rule], old_rules: list[Rule] | None = None) -> DataFrame:
    """As `plan`, from changes (path, status) that are known already; `new` are all files where rules changed."""
    todo = wanted(changes.select("path", "status"), new_rules).dropDuplicates(["path"])
    if old_rules is None:
        return todo
    more = readmitted(new, old_rules, new_rules).join(todo.select("path"), "path", "left_anti")
    return todo.unionByName(more.select("path", F.lit("A").alias("status")))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def _placed(rows: DataFrame, kind: str, hash_: Column) -> DataFrame:
    """Rows (path) as children of their directories."""
    path = F.col("path")
    depth = F.size(F.split(path, "/"))
    return rows.select(_parent(path).alias("directory"), F.substring_index(path, "/", -1).alias("name"), F.lit(kind).alias("kind"), hash_.alias("hash"), depth.alias("depth"))


def with_directories(files: DataFrame) -> DataFrame:
    """(directory, name, kind, hash) of the files (path, content_hash) and of all directories; the root's path is empty.

    A directory's hash is made of sums over its children, which have no order, so no directory is gathered in
    one row. One aggregation for each level, from the deepest; made once for a snapshot and kept.
    """
    out = _placed(files, "blob", F.col("content_hash"))
    for level in range(out.agg(F.max("depth")).first()[0] or 0, 1, -1):
        digest = F.sha2(F.concat_ws("|", "kind", F.coalesce("hash", F.lit("")), "name"), 256)
        sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{at}") for at in (1, 16, 31, 46)]
        trees = out.where(F.col("depth") == level).groupBy(F.col("directory").alias("path")).agg(*sums)
        out = out.unionByName(_placed(trees, "tree", F.sha2(F.concat_ws(",", "s1", "s16", "s31", "s46"), 256)))
    return out.select("directory", "name", "kind", "hash")


def tree_changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, status) of the files in which two snapshots with directories differ, and (path) of the directories compared.

    Level by level, only directories whose hashes differ are opened: the rest of both snapshots is never joined.
    """
    spark = old.sparkSession
    folder, level = scratch_folder(spark), 0
    schema = "kind string, path string, was boolean, there boolean"
    front = spark.createDataFrame([("",)], "at string")
    while True:

        def children(rows: DataFrame, hash_: str, side: str, front: DataFrame = front) -> DataFrame:
            return rows.join(front, rows["directory"] == front["at"], "left_semi").select("directory", "name", "kind", F.col("hash").alias(hash_), F.lit(True).alias(side))

        both = children(old, "old", "was").join(children(new, "new", "there"), ["directory", "name", "kind"], "full_outer")
        path = F.when(F.col("directory") == "", F.col("name")).otherwise(F.concat_ws("/", "directory", "name"))
        sides = [F.coalesce(c, F.lit(False)).alias(c) for c in ("was", "there")]
        both.where(F.col("was").isNull() | F.col("there").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select("kind", path.alias("path"), *sides).write.parquet(f"{folder}/{level}")
        front, level = spark.read.schema(schema).parquet(f"{folder}/{level}").where("kind = 'tree'").select(F.col("path").alias("at")), level + 1
        if front.isEmpty():
            break
    every = spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in range(level)])
    status = F.when(~F.col("was"), "A").when(~F.col("there"), "D").otherwise("M")
    return every.where("kind = 'blob'").select("path", status.alias("status")), every.where("kind = 'tree'").select("path")
