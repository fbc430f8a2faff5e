"""The stored table: what a change writes, which files a lookup opens, and readers while it is folded."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.predicates import of_ref, stale_of_path
from strandline.model import INDEX_SCHEMA, StoreError
from strandline.operators.chunk import WholeFileChunker
from strandline.operators.embed import HashEmbedder
from strandline.plans.refresh import refresh
from strandline.sources.table import IndexTable


def row(n, text="x", path=None, ref="main", token="t"):
    return (f"id{n}", "repo", ref, path or f"dir/{n:04}.md", "", "parent", text, "c", token, "s", "h", [0.0, float(n)])


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.fixture
def table(spark, tmp_path):
    return IndexTable(spark, (tmp_path / "table").as_uri(), 8)


def ids(table, **more):
    return {r["id"] for r in table.read(**more).select("id").collect()}


def test_changes_equal_a_rewritten_table(spark, table):
    rng, have = random.Random(3), {}
    for step in range(6):
        manifest = table.manifest()
        gone = set(rng.sample(sorted(have), min(len(have), 20)))
        new = {n: row(n, f"{step}") for n in rng.sample(range(300), 40)}
        gone |= set(new) & set(have)
        here = table.read(manifest=manifest, places=True)
        out = here.where(F.col("id").isin([f"id{n}" for n in gone])).select("_file", "_row") if gone else None
        table.change(spark.createDataFrame(list(new.values()), INDEX_SCHEMA), out, manifest)
        have = {n: r for n, r in have.items() if n not in gone} | new
        assert {(r["id"], r["text"]) for r in table.read().collect()} == {(r[0], r[6]) for r in have.values()}
        assert table.count() == len(have)
        if step == 3:
            before = table.manifest()
            old_reader = table.read(manifest=before)
            table.compact()
            assert table.debt() == 0 and not table.manifest()["marks"]
            assert old_reader.count() == len(have)  # a reader that began before goes on
    table.vacuum(1)
    assert table.count() == len(have) == table.read().count()


def test_two_writers_of_one_version(spark, table):
    manifest = table.manifest()
    table.commit(spark.createDataFrame([row(1)], INDEX_SCHEMA), manifest)
    with pytest.raises(StoreError):
        table.change(spark.createDataFrame([row(2)], INDEX_SCHEMA), None, manifest)
    assert ids(table) == {"id1"}


def test_a_failed_write_leaves_the_table_as_it_was(spark, table):
    table.commit(spark.createDataFrame([row(1)], INDEX_SCHEMA), table.manifest())
    broken = spark.createDataFrame([row(2)], INDEX_SCHEMA).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        table.change(broken, None, table.manifest())
    assert ids(table) == {"id1"} and table.manifest()["version"] == 1


def test_lookups_open_only_files_that_may_hold_the_value(spark, table):
    table.commit(spark.createDataFrame([row(n) for n in range(400)], INDEX_SCHEMA), table.manifest())
    for n in range(400, 404):
        table.change(spark.createDataFrame([row(n, ref=f"branch{n}", token=f"t{n}")], INDEX_SCHEMA), None, table.manifest())
    manifest = table.manifest()
    assert len(manifest["files"]) >= 8
    one = table.files_with({"path": "dir/0007.md"}, manifest)
    assert len(one) == 1 and ids(table, facts={"path": "dir/0007.md"}) >= {"id7"}
    assert len(table.files_with({"ref": "branch402"}, manifest)) == 1
    assert table.files_with({"ref": "branch402", "path": "dir/0007.md"}, manifest) == []
    assert table.files_with({"path": "dir/9999.md"}, manifest) == [] and table.read(facts={"path": "dir/9999.md"}).count() == 0
    assert len(table.files_with({"path": ""}, manifest)) == len(manifest["files"])  # null counts as empty: nothing to skip by
    paths = spark.createDataFrame([(f"dir/{n:04}.md",) for n in (401, 403)], "value string")
    assert len(table.files_of(paths, "path", manifest)) == 2
    # every value is found by its own lookup
    every = spark.createDataFrame([(f"dir/{n:04}.md",) for n in range(404)], "value string")
    assert set(table.files_of(every, "path", manifest)) == set(manifest["files"])
    assert table.delete_where(stale_of_path("repo", "main", "dir/0007.md", "other"), {"repo_id": "repo", "ref": "main", "path": "dir/0007.md"}) == 1
    assert table.count() == 403 and "id7" not in ids(table)


def test_long_and_null_values(spark, table):
    rows = [row(1, path="p" * 500), row(2, path="p" * 499 + "q"), (*row(3)[:3], None, *row(3)[4:])]
    table.commit(spark.createDataFrame(rows, INDEX_SCHEMA), table.manifest())
    assert "id2" in ids(table, facts={"path": "p" * 499 + "q"}) and "id1" in ids(table, facts={"path": "p" * 500})
    assert ids(table, facts={"path": ""}) == {"id1", "id2", "id3"}
    empty = IndexTable(spark, f"{table.path}-empty", 4)
    assert empty.read().count() == 0 and empty.read(places=True, facts={"path": "x"}).count() == 0 and empty.count() == 0 and empty.delete_where(F.lit(True)) == 0


def test_a_small_sync_writes_little(spark, tmp_path):
    table = IndexTable(spark, (tmp_path / "table").as_uri(), 8)
    rng = random.Random(5)
    texts = [(f"f{n}.md", " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(700))) for n in range(1000)]
    files = spark.createDataFrame(texts, "path string, text string")
    refresh(table, files.select("path"), files, WholeFileChunker(), HashEmbedder(), "repo", "main", "c1", "t1")
    full = size(tmp_path / "table")
    changed = files.where("path in ('f1.md', 'f500.md', 'f999.md')").withColumn("text", F.concat("text", F.lit(" more")))
    counts = refresh(table, changed.select("path"), changed, WholeFileChunker(), HashEmbedder(), "repo", "main", "c2", "t2")
    assert (counts.added, counts.deleted) == (3, 3) and table.count() == 1000
    assert size(tmp_path / "table") - full < 0.02 * full
    assert table.read().where(of_ref("repo", "main") & (F.col("content_commit") == "c2")).count() == 3


def test_a_value_has_all_its_bits_in_one_word_of_a_filter(spark, table):
    for step in range(3):
        table.change(spark.createDataFrame([row(n) for n in range(200 * step, 200 * step + 200)], INDEX_SCHEMA), None, table.manifest())
    manifest = table.manifest()
    words = spark.read.parquet(*[f"{table.path}/{m}" for m in manifest["filters"]]).where("field = 'path'").count()
    assert words <= 600  # so a lookup meets a file once a value and sums nothing up
    for n in (0, 250, 599):
        holding = {r[0] for r in table.read(places=True).where(F.col("id") == f"id{n}").select("_file").collect()}
        found = table.files_of(spark.createDataFrame([(f"dir/{n:04}.md",)], "value string"), "path", manifest)
        assert holding <= set(found) < set(manifest["files"])
    # files that an earlier version wrote have other filters: they may hold anything
    old = manifest | {"filters": [m.replace("blooms/", "filters/") for m in manifest["filters"]]}
    assert table.files_of(spark.createDataFrame([("dir/0000.md",)], "value string"), "path", old) == list(manifest["files"])
