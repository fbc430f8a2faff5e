"""The index as Parquet: files of rows, marks of deleted ones, and manifests that say which of them make up a version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.model import INDEX_SCHEMA, StoreError

LOOKED_UP = ("repo_id", "ref", "path", "seen_token")
ZONE_CHARS = 64
HASHES = 4
MARKS = "file string, word long, bits long"
FILTERS = "file string, field string, mask long, word long, bits long"


class IndexTable:
    """Readers see one manifest and so one whole sync. A write adds new files and then a manifest.

    The manifest of a number is created once, never replaced: of two writers only one succeeds, and what
    a crash leaves behind belongs to no manifest. All files are reached through Hadoop's file systems.

    A first build lies in buckets by path. A small change adds a few files of new rows and marks the old rows as
    deleted, by file and place; a reader takes what is not marked. `compact` folds both into the buckets.
    The manifest holds for each file its rows, how many are marked, and the least and largest value of `LOOKED_UP`;
    Bloom filters of these fields lie beside it, so a lookup opens only files that may hold its value.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """The newest manifest, or that of a version: version, buckets (their number), files, and the folders of marks and filters."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "buckets": self._buckets, "files": {}, "marks": [], "filters": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest/{max(numbers) if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @property
    def exists(self) -> bool:
        return self.manifest()["version"] > 0

    def bucket(self, manifest: dict[str, Any] | None = None) -> Column:
        """The bucket of a row by its path."""
        return F.pmod(F.xxhash64("path"), F.lit((manifest or self.manifest())["buckets"])).cast("int")

    def read(self, files: list[str] | None = None, manifest: dict[str, Any] | None = None, facts: dict[str, str] | None = None, places: bool = False) -> DataFrame:
        """The rows that are there: all, or those in some files, or in files that may hold rows with the values `facts` of `LOOKED_UP`.

        With `places` also each row's `_file` and `_row`, its place there. The caller still filters by the facts.
        """
        manifest = manifest or self.manifest()
        names = [n for n in manifest["files"] if files is None or n in set(files)]
        if facts:
            names = self.files_with(facts, manifest, names)
        plain = [n for n in names if not manifest["files"][n]["marked"]]
        marked = [n for n in names if manifest["files"][n]["marked"]]
        columns = [*INDEX_SCHEMA.fieldNames(), "_file", "_row"] if places else INDEX_SCHEMA.fieldNames()
        out = None
        if plain or not marked:
            out = (self._placed(plain, places) if plain else self._nothing(places)).select(*columns)
        if marked:
            word, bit = F.shiftright("_row", 6), F.expr("shiftleft(1L, cast(_row & 63 as int))")
            marks = self._marks(manifest).where(F.col("file").isin(marked)).groupBy("file", "word").agg(F.expr("bit_or(bits)").alias("bits"))
            rows = self._placed(marked, True)
            joined = rows.join(marks, (F.col("_file") == F.col("file")) & (word == F.col("word")), "left")
            rest = joined.where(F.coalesce(F.col("bits").bitwiseAND(bit), F.lit(0)) == 0).select(*columns)
            out = rest if out is None else out.unionByName(rest)
        return out

    def _placed(self, names: list[str], places: bool) -> DataFrame:
        rows = self.spark.read.schema(INDEX_SCHEMA).parquet(*[f"{self.path}/data/{n}" for n in names])
        return rows.select("*", _file_of(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row")) if places else rows

    def _nothing(self, places: bool) -> DataFrame:
        empty = self.spark.createDataFrame([], INDEX_SCHEMA)
        return empty.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row")) if places else empty

    def _marks(self, manifest: dict[str, Any]) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(*[f"{self.path}/{m}" for m in manifest["marks"]])

    def count(self) -> int:
        """Number of rows, known from the manifest."""
        return sum(f["rows"] - f["marked"] for f in self.manifest()["files"].values())

    def added_since(self, version: int, manifest: dict[str, Any] | None = None) -> DataFrame:
        """The rows in files that manifests after this version brought; rows that were only moved come again."""
        manifest = manifest or self.manifest()
        return self.read([n for n, f in manifest["files"].items() if f["since"] > version], manifest)

    def files_with(self, facts: dict[str, str], manifest: dict[str, Any], names: list[str] | None = None) -> list[str]:
        """The files that may hold rows with all these values: first by least and largest value, then by the filters."""
        names = list(manifest["files"]) if names is None else names
        for field, value in facts.items():
            if value == "":  # the filter language takes null as the empty string
                continue
            names = [n for n in names if (zone := manifest["files"][n]["zones"].get(field)) and zone[0] <= value <= zone[1]]
            if len(names) > 1:
                one = self.spark.createDataFrame([(value,)], "value string")
                names = self.files_of(one, field, manifest, names)
        return names

    def files_of(self, values: DataFrame, field: str, manifest: dict[str, Any], names: list[str] | None = None) -> list[str]:
        """The files that may hold any of the values (value) in the field, by the Bloom filters: a value has all its bits in one word, so a join on words tells."""
        names = list(manifest["files"]) if names is None else names
        own = [m for m in manifest["filters"] if m.startswith("blooms/")]

        def known(name: str) -> bool:
            return f"blooms/{name.split('/')[0]}" in own  # else an earlier version wrote it, and it may hold anything

        if not any(known(n) for n in names):
            return names
        filters = self.spark.read.schema(FILTERS).parquet(*[f"{self.path}/{m}" for m in own]).where(F.col("field") == field)
        masks = F.array(*[F.lit(m).cast("long") for m in sorted({_mask(manifest["files"][n]["rows"]) for n in names})])
        asked = values.where("value is not null").select(F.explode(masks).alias("m"), F.xxhash64("value").alias("h"))
        asked = asked.select("m", _word(F.col("h"), F.col("m")).alias("w"), _bits(F.col("h")).alias("bit"))
        hit = filters.join(asked, (F.col("mask") == F.col("m")) & (F.col("word") == F.col("w")) & (F.col("bits").bitwiseAND(F.col("bit")) == F.col("bit")))
        found = {r[0] for r in hit.select("file").distinct().collect()}
        return [n for n in names if n in found or not known(n)]

    def _written(self, rows: DataFrame, manifest: dict[str, Any], bucketed: bool) -> tuple[dict[str, Any], str]:
        """Writes rows as new files with their filters; gives what the manifest says of the files, and the folder of the filters."""
        number = manifest["version"] + 1
        name = f"v={number}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/data/{name}"
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX_SCHEMA])
        if bucketed:
            # rows of a bucket meet in few files; small buckets share a task and large ones are split, as their sizes turn out
            out.withColumn("bucket", self.bucket(manifest)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
        else:
            out.hint("rebalance").write.parquet(target)
        fields = self.spark.read.schema(StructType([f for f in INDEX_SCHEMA if f.name in LOOKED_UP])).parquet(target)
        fields = fields.select(*LOOKED_UP, _file_of(F.col("_metadata.file_path")).alias("file"))
        zones = fields.groupBy("file").agg(F.count("*").alias("rows"), *[g(c).alias(f"{n}_{c}") for c in LOOKED_UP for n, g in (("least", F.min), ("most", F.max))])
        files = {}
        for r in zones.collect():  # a row a file
            bucket = r["file"].split("/bucket=")[1].split("/")[0] if "/bucket=" in r["file"] else None
            files[r["file"]] = {"rows": r["rows"], "marked": 0, "bucket": bucket, "since": number, "zones": {c: _zone(r[f"least_{c}"], r[f"most_{c}"]) for c in LOOKED_UP if r[f"least_{c}"] is not None}}
        filters = f"blooms/{name}"
        masks = self.spark.createDataFrame([(n, _mask(f["rows"])) for n, f in files.items()], "file string, mask long")
        _filters(fields, masks).coalesce(max(1, len(files) // 8)).write.parquet(f"{self.path}/{filters}")
        return files, filters

    def _next(self, manifest: dict[str, Any], files: dict[str, Any], filters: list[str], marks: list[str]) -> dict[str, Any]:
        number = manifest["version"] + 1
        filters = [f for f in filters if f.split("/")[1] in {n.split("/")[0] for n in files}]
        marks = marks if any(f["marked"] for f in files.values()) else []
        new = {"version": number, "buckets": manifest["buckets"], "files": files, "marks": marks, "filters": filters}
        self._create(f"{self.path}/manifest/{number}.json", json.dumps(new, sort_keys=True))
        return new

    def commit(self, rows: DataFrame, manifest: dict[str, Any]) -> dict[str, Any]:
        """Makes `rows` the whole content in the version after `manifest`."""
        files, filters = self._written(rows, manifest, True)
        return self._next(manifest, files, [filters], [])

    def change(self, rows: DataFrame | None, gone: DataFrame | None, manifest: dict[str, Any]) -> dict[str, Any]:
        """Adds `rows` and marks the rows at the places `gone` (_file, _row) as deleted: what is written follows the change."""
        files, filters, marks = {n: dict(f) for n, f in manifest["files"].items()}, list(manifest["filters"]), list(manifest["marks"])
        if gone is not None:
            folder = f"marks/v={manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
            bits = gone.groupBy(F.col("_file").alias("file"), F.shiftright("_row", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(_row & 63 as int)))").alias("bits"))
            bits.hint("rebalance").write.parquet(f"{self.path}/{folder}")
            for r in self.spark.read.schema(MARKS).parquet(f"{self.path}/{folder}").groupBy("file").agg(F.sum(F.expr("bit_count(bits)")).alias("n")).collect():
                files[r["file"]]["marked"] += r["n"]
                marks = [*marks, folder] if folder not in marks else marks
            files = {n: f for n, f in files.items() if f["marked"] < f["rows"]}
        if rows is not None:
            new, own = self._written(rows, manifest, False)
            files, filters = files | new, [*filters, own]
        return self._next(manifest, files, filters, marks)

    def debt(self, manifest: dict[str, Any] | None = None) -> float:
        """What share of the stored rows lies outside the buckets or is marked as deleted."""
        files = (manifest or self.manifest())["files"].values()
        return sum(f["rows"] if f["bucket"] is None else f["marked"] for f in files) / max(1, sum(f["rows"] for f in files))

    def compact(self, share: float = 0.0) -> dict[str, Any]:
        """Folds the added files, and the marks of the buckets they touch or of which more than `share` is marked, into new files of those buckets. Readers go on with the files they know."""
        manifest = self.manifest()
        loose = [n for n, f in manifest["files"].items() if f["bucket"] is None]
        touched = {f["bucket"] for f in manifest["files"].values() if f["bucket"] is not None and f["marked"] > share * f["rows"]}
        if loose:
            touched |= {str(r[0]) for r in self.read(loose, manifest).select(self.bucket(manifest)).distinct().collect()}
        if not touched:
            return manifest
        old = [n for n, f in manifest["files"].items() if f["bucket"] is None or f["bucket"] in touched]
        files, filters = self._written(self.read(old, manifest), manifest, True)
        return self._next(manifest, {n: f for n, f in manifest["files"].items() if n not in set(old)} | files, [*manifest["filters"], filters], manifest["marks"])

    def _create(self, path: str, text: str) -> None:
        draft = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(draft, self._path(path)):
            self._fs.delete(draft, False)
            raise StoreError(f"another writer made {path}")

    def delete_where(self, predicate: Column, facts: dict[str, str] | None = None) -> int:
        """Marks the rows for which the predicate is true; gives their number. With `facts`, values that it asks for, only files that may hold them are read."""
        manifest = self.manifest()
        hit = self.read(manifest=manifest, facts=facts, places=True).where(F.coalesce(predicate, F.lit(False))).select("_file", "_row")
        before = sum(f["rows"] - f["marked"] for f in manifest["files"].values())
        after = self.change(None, hit, manifest)
        return before - sum(f["rows"] - f["marked"] for f in after["files"].values())

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the newest `keep`, files that no kept manifest names, and the plans and findings of earlier commands. Not while a sync runs."""
        newest = self.manifest()["version"]
        used: set[str] = set()
        for number in self._numbers():
            if number > newest - keep:
                manifest = self.manifest(number)
                used |= {f"data/{n.split('/')[0]}" for n in manifest["files"]} | set(manifest["marks"]) | set(manifest["filters"])
            else:
                self._fs.delete(self._path(f"{self.path}/manifest/{number}.json"), False)
        for kind in ("data", "marks", "filters", "blooms"):
            folder = self._path(f"{self.path}/{kind}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{kind}/{status.getPath().getName()}" not in used:
                    self._fs.delete(status.getPath(), True)
        for kind in ("plans", "checks", "staging"):
            self._fs.delete(self._path(f"{self.path}/{kind}"), True)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _file_of(path: Column) -> Column:
    """The part of a file's path by which the manifest names it."""
    return F.substring_index(path, "/data/", -1)


def _zone(least: str, most: str) -> list[str]:
    """Bounds of values; long ones are cut, the upper one upwards."""
    return [least[:ZONE_CHARS], most if len(most) <= ZONE_CHARS else most[:ZONE_CHARS] + chr(0x10FFFF)]


def _word(hash_: Column, mask: Column) -> Column:
    """The word of a filter that holds the bits of a value, by the lower half of its hash."""
    return F.shiftright(hash_.bitwiseAND(mask), 6)


def _bits(hash_: Column) -> Column:
    """The bits of a value in its word, by the upper half of its hash."""
    at = [F.shiftrightunsigned(hash_, 64 - 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(1, HASHES + 1)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at])


def _mask(rows: int) -> int:
    """The places of a file's filters, a power of two, less one: 16 a row at least, up to 67 million; only words with bits are stored."""
    return (1 << min(max(10, (16 * rows - 1).bit_length()), 26)) - 1


def _filters(fields: DataFrame, masks: DataFrame) -> DataFrame:
    """(file, field, mask, word, bits): a Bloom filter for each file and field, as the words that have bits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in LOOKED_UP])).alias("p")
    values = fields.select("file", pairs).select("file", "p.field", "p.value").where("value is not null")
    placed = values.join(F.broadcast(masks), "file").select("file", "field", "mask", F.xxhash64("value").alias("h"))  # a row a new file
    return placed.groupBy("file", "field", "mask", _word(F.col("h"), F.col("mask")).alias("word")).agg(F.bit_or(_bits(F.col("h"))).alias("bits"))


# Stores by the name that a configuration gives: what makes one of a session, a path and the options. Others register here.
STORES: dict[str, Callable[[SparkSession, str, dict[str, Any]], IndexTable]] = {"parquet": lambda spark, path, options: IndexTable(spark, path, int(options.get("buckets", 16)))}


def create_store(spark: SparkSession, name: str, path: str, options: dict[str, Any] | None = None) -> IndexTable:
    """The store of that name; an unknown one is an error."""
    if (make := STORES.get(name)) is None:
        raise StoreError(f"unknown vector store {name!r}; known: {', '.join(sorted(STORES))}")
    return make(spark, path, options or {})


def export_json(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines, ordered by id over the files."""
    rows.orderBy("id").write.json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files {"docs": [...]}; those without id are left out, of equal ids the last one of a file stays."""
    from pyspark.sql import Window
    from pyspark.sql.types import ArrayType, StructField, StructType

    docs = spark.read.schema(StructType([StructField("docs", ArrayType(INDEX_SCHEMA))])).json(path, multiLine=True)
    rows = docs.select(F.posexplode("docs").alias("pos", "doc")).select("pos", "doc.*").where(F.col("id").isNotNull() & (F.col("id") != ""))
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "pos")
