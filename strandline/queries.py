"""Queries over the driver's tables, one for each group of operators, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.ignore import ignored, parse_rules
from strandline.functions.predicates import of_ref, stale_of_path, where
from strandline.functions.text import content_hash, estimated_tokens, hash_embedding, model_name, none_if_blank, normalize, normalize_newlines, py_strip, short_id, state_label
from strandline.operators.chunk import HeadingChunker, WholeFileChunker, WindowChunker, chunk_files, expected_rows, heading_paths, whole_file_chunks, with_keys
from strandline.operators.delta import change_set, plan, tree_changes, wanted, with_directories
from strandline.operators.embed import HashEmbedder, embed_rows
from strandline.operators.graph import build_graph, graph_top_k_each
from strandline.operators.lineage import ahead
from strandline.operators.long_files import chunk_lines
from strandline.operators.merge import classified, merged, new_rows, update, upsert
from strandline.operators.reconcile import differences
from strandline.operators.rules import with_verdict
from strandline.operators.search import approximate_top_k_each, inverted_file, top_k, top_k_each
from strandline.operators.vector_index import VectorIndex
from strandline.operators.verify import file_checks, ignored_stale, stale_deleted
from strandline.sources.scratch import scratch_folder, staged
from strandline.plans.refresh import Counts, refresh
from strandline.sources.snapshot import listing
from strandline.sources.table import IndexTable, create_store
from strandline.streaming.replay import CHANGES, follow, latest

LARGE = 10**9
REPO, REF = "repo", "main"
OLD_RULES = "src1*/\n!src12/\n/src2/en/\nsrc4/**\n"
NEW_RULES = "# sources\nsrc1*/\n!src12/\n!/src14\n/src2/en/\n**/7?.md\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, snapshot: str = "all") -> DataFrame:
    """The documents as files (path, text, content_hash) of two snapshots that differ by fixed rules on the id."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    rest = F.col("doc_id") % 10
    text = F.col("text")
    if snapshot == "old":
        docs = docs.where(rest != 0)
    elif snapshot == "new":
        docs, text = docs.where(rest != 1), F.when(rest == 2, F.concat("text", F.lit(" (edited)"))).otherwise(text)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(path.alias("path"), text.alias("text"), content_hash(text).alias("content_hash"))


def headed(rows: DataFrame) -> DataFrame:
    """Files of two chunks: a heading that no edit changes, and the text."""
    return rows.select("path", F.concat(F.lit("# file\n"), F.col("text")).alias("text"))


def q01_snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(files(spark, sf_dir))


def q02_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_set(files(spark, sf_dir, "old"), files(spark, sf_dir, "new"))


def q30_tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change set of q02 by hashes of directories, of which only those that differ are opened."""
    old, new = (staged(with_directories(files(spark, sf_dir, n)), n) for n in ("old", "new"))
    return tree_changes(old, new)[0]


def q03_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(".git/config", "A"), (".strandlineignore", "M"), ("./.strandline/x", "D"), ("src1.md", "A")], "path string, status string")
    changes = change_set(files(spark, sf_dir, "old"), files(spark, sf_dir, "new")).unionByName(own)
    return wanted(changes, parse_rules(NEW_RULES))


def q34_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand rules, most for one file each, on all documents, by look-ups."""
    lines = [f"/src{i % 20}/en/{i}.md" if i % 2 else f"!{i}.md" for i in range(10_000)]
    rules = parse_rules("\n".join([*OLD_RULES.split("\n"), *lines, "src3/**/1*.md", "*9.md"]))
    return with_verdict(files(spark, sf_dir).select("path"), rules)


def q04_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(files(spark, sf_dir, "old"), files(spark, sf_dir, "new"), parse_rules(NEW_RULES), parse_rules(OLD_RULES))


def q05_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit("---\nkey: 1\n---\n"), F.replace(F.replace("text", F.lit(". "), F.lit(".\t  \r\n")), F.lit(", "), F.lit(", \t  ")), F.lit("  \r"))
    # each step is a projection of its own, so that what both results share is computed once
    ends = docs.select("doc_id", normalize_newlines(noisy).alias("text"))
    later = {"normalize_newlines": False}
    both = ends.select("doc_id", normalize(F.col("text"), later | {"strip_frontmatter": True, "collapse_whitespace": True}).alias("clean"), normalize(F.col("text"), later).alias("plain"))
    return both.select("doc_id", content_hash(F.col("clean")).alias("all_steps"), content_hash(F.col("plain")).alias("default_steps"), F.length("clean").cast("long").alias("n"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation: a heading, then one for each turn; every third begins with a deeper heading or with plain text."""
    turns = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("part"))
    # a conversation has a handful of turns
    grouped = turns.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(turn)).getField("part"), "").alias("body"))
    start = F.when(F.col("conv_id") % 3 == 1, "### note\n## part\n").when(F.col("conv_id") % 3 == 2, "before\n").otherwise("")
    return grouped.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(start, F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("body")).alias("text"))


def q06_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heading_paths(conversation_files(spark, sf_dir))
    return rows.select("path", F.col("line").cast("long").alias("line"), "heading", F.col("level").cast("long").alias("level"), "heading_path")


def q07_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_files(conversation_files(spark, sf_dir), HeadingChunker(LARGE))
    return chunks.select("path", F.col("pos").cast("long").alias("pos"), "chunk_type", "heading_path", content_hash(F.col("text")).alias("content_hash"))


def q08_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_files(files(spark, sf_dir), WindowChunker(1000, 100))
    return chunks.select("path", F.col("pos").cast("long").alias("pos"), "chunk_type", content_hash(F.col("text")).alias("content_hash"))


def q32_long_file_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source, one after another, as one file, cut by many tasks."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null and source is not null")
    lines = docs.select(F.col("source").alias("path"), F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    chunks = chunk_lines(lines.select("path", "part", F.struct("doc_id", "i").alias("place"), "text"), WindowChunker(1000, 100), block=1 << 20)
    return chunks.select("path", F.col("pos").cast("long").alias("pos"), "chunk_type", content_hash(F.col("text")).alias("content_hash"), F.col("dup_index").cast("long").alias("dup_index"))


def q09_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_file_chunks(files(spark, sf_dir)).select("path", "chunk_type", content_hash(F.col("text")).alias("content_hash"))


def q10_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = files(spark, sf_dir).select("path", F.concat(F.lit("# a\n## b\n"), F.col("text"), F.lit("\n## b\n"), F.col("text")).alias("text"))
    chunks = chunk_files(doubled, HeadingChunker(LARGE))
    keyed = with_keys(chunks, REPO, REF, "c1", "t1", "markdown-heading-v1")
    return keyed.select("id", "path", "chunk_type", "heading_path", "content_hash")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expected_rows(headed(files(spark, sf_dir, "old")), HeadingChunker(LARGE), None, REPO, REF, "c1", "t1")
    return staged(embed_rows(rows, HashEmbedder()).drop("calls"), "index")


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new = files(spark, sf_dir, "new")
    todo = change_set(files(spark, sf_dir, "old"), new)
    changed = new.join(todo.where("status <> 'D'").select("path"), "path", "left_semi")
    return todo, staged(expected_rows(headed(changed), HeadingChunker(LARGE), None, REPO, REF, "c2", "t2"), "expected")


def q11_new_or_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, expected = _expected(spark, sf_dir)
    return classified(expected, _index(spark, sf_dir).select("id")).select("id", "path", "op")


def q12_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    todo, expected = _expected(spark, sf_dir)
    fresh = embed_rows(new_rows(expected, index), HashEmbedder())
    todo = staged(todo, "todo")
    rows = merged(index, fresh, expected, todo)
    return rows.select("id", "path", "chunk_type", "content_commit", "seen_token", "content_hash", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def q13_delete_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = whole_file_chunks(files(spark, sf_dir)).withColumn("lang", F.split("path", "/").getItem(1))
    hit = F.coalesce(where("lang == 'en' AND chunk_type != 'child'", index.columns), F.lit(False))
    return index.agg(F.count("*").alias("before"), F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("after"))


def q14_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    expression = "c_mktsegment == 'BUILDING' AND c_nationkey != \"3\" AND missing != 'x' AND absent == ''"
    return customers.where(where(expression, customers.columns)).select("c_custkey", "c_name", "c_mktsegment")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def q15_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "embeddings")
    found = top_k(index, _query_vector(spark, sf_dir), 10, where("label != '3'", index.columns), "vec_id")
    return found.select("vec_id", "label", F.round("score", 9).alias("score"))


def q16_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(hash_embedding(F.col("text"))).alias("place", "value"))
    return items.select("item_id", F.col("place").cast("long").alias("place"), F.round("value", 9).alias("value"))


def commit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, parent_id): a history with merges, and two commits of another branch, made from the nations' keys."""
    key = F.col("n_nationkey").cast("long")
    nations = table(spark, sf_dir, "nation")
    edges = nations.where(key > 2).select(key.alias("commit_id"), (key - 3).alias("parent_id"))
    merges = nations.where((key % 5 == 4) & (key > 4)).select(key.alias("commit_id"), (key - 4).alias("parent_id"))
    branch = spark.createDataFrame([(100, 9), (101, 100)], "commit_id long, parent_id long")
    return edges.unionByName(merges).unionByName(branch)


def q17_commits_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    behind = ahead(commit_graph(spark, sf_dir), since=101, until=24)
    return behind.agg(F.count("*").alias("commits_behind")).select(F.lit("OUT_OF_DATE").alias("state"), "commits_behind")


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An index with missing rows, unknown ids and unknown paths, and the rows that its files ask for."""
    expected = staged(expected_rows(headed(files(spark, sf_dir)), HeadingChunker(LARGE), None, REPO, REF, "c1", "verify").select("path", "id"), "expected")
    index = expected.where("id >= '1'")
    extra = expected.where("id < '08'")
    index = index.unionByName(extra.select("path", F.concat(F.lit("x"), "id").alias("id")))
    return index.unionByName(extra.select(F.concat(F.lit("gone/"), "path").alias("path"), "id")), expected


def _findings(index: DataFrame, expected: DataFrame, have: DataFrame, want: DataFrame) -> DataFrame:
    left_out = ignored(F.col("path"), parse_rules("/src5/\n"))
    paths = expected.select("path").distinct().where(~left_out)
    checks = file_checks(have, want, paths).where("status = 'FAIL'").select("path", F.array_join("issues", ",").alias("issue"), "missing_count", "stale_count")
    gone = stale_deleted(have, paths, left_out).select("path", F.lit("STALE_DELETED").alias("issue"), F.lit(0).cast("long").alias("missing_count"), "stale_count")
    out = ignored_stale(index, left_out).select("path", F.lit("IGNORED").alias("issue"), F.lit(0).cast("long").alias("missing_count"), F.lit(0).cast("long").alias("stale_count"))
    return checks.unionByName(gone).unionByName(out)


def q18_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of an index against its files."""
    index, expected = _verified(spark, sf_dir)
    return _findings(index, expected, index, expected)


def q33_verify_by_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of q18 from what differs alone, which sketches of both sides tell."""
    index, expected = _verified(spark, sf_dir)
    found = staged(differences(index, expected), "differences")
    return _findings(index, expected, found.where("have"), found.where("want"))


def q19_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("texts"), F.sum(estimated_tokens(F.col("text"))).alias("tokens"))


def q20_top_k_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = index.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    found = top_k_each(index, queries, 10)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def q20b_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of q20 by the stored inverted file, 12 of 16 cells each: recall of 0.95 or more against q20."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    folder = scratch_folder(spark)
    centres = inverted_file(index, folder)
    celled = spark.read.parquet(folder)
    queries = index.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    found = approximate_top_k_each(celled, centres, queries, 10)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def q29_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of q20, over ids that are strings as those of an index are, by codes of quantised residuals: recall of 0.9 or more against q20."""
    index = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.lit("p").alias("path"), "embedding")
    codes = VectorIndex(spark, scratch_folder(spark))
    codes.build(index)
    queries = index.where(F.substring("id", 2, 20).cast("long") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")
    found = codes.top_k_each(index, queries, 10)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def q31_proximity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of q20 by walks over a graph of neighbours: recall of 0.9 or more against q20."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    folder = scratch_folder(spark)
    build_graph(index, folder)
    queries = index.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    found = graph_top_k_each(spark, folder, queries, 10)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def q21_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of changes to users, applied batch by batch: the state is the last event of each user."""
    folder = scratch_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    state = {"at": None}

    def step(batch: DataFrame, number: int) -> None:
        last = latest(batch, "user_id", ("ts", "event_id"))
        if state["at"] is None:
            rows = last
        else:
            old = spark.read.schema(batch.schema).parquet(state["at"])
            rows = upsert(old.withColumnRenamed("user_id", "id"), latest(old.unionByName(last).join(last.select("user_id"), "user_id", "left_semi"), "user_id", ("ts", "event_id")).withColumnRenamed("user_id", "id")).withColumnRenamed("id", "user_id")
        target = f"{folder}/state-{number}-{uuid.uuid4().hex[:8]}"
        rows.select(*batch.columns).write.parquet(target)
        state["at"] = target

    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    source.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(state["at"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def q22_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    provider = F.concat(F.lit("provider:"), "lang", F.lit(":"), "source")
    state = F.when(F.col("doc_id") % 2 == 0, "UP_TO_DATE").otherwise("other_state")
    blank = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("\n"), "source", F.lit(" ")))
    return docs.select("doc_id", short_id(content_hash(F.col("text"))).alias("short"), model_name(provider).alias("model"), state_label(state).alias("label"), none_if_blank(blank).alias("filled"))


def q23_upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-replace of whole rows, then an update of one field; unknown ids of an update do nothing."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("segment"))
    rows = upsert(customers, suppliers)
    changes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("segment")).where("id % 7 = 0")
    return update(rows, changes)


def q24_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table: written whole, rows deleted by two predicates, counted by its manifest and by a filtered scan."""
    index = create_store(spark, "parquet", scratch_folder(spark), {"buckets": 8})
    rows = with_keys(whole_file_chunks(files(spark, sf_dir)), REPO, REF, "c1", "t1", "whole-file")
    index.commit(embed_rows(rows, HashEmbedder()), index.manifest())
    before = index.count()
    first = rows.where(~F.col("path").contains("/fr/")).agg(F.min("path")).first()[0]
    gone = index.delete_where(F.col("path").contains("/fr/"))
    stale = index.delete_where(stale_of_path(REPO, REF, first or "", "t2"))
    here = index.read().where(of_ref(REPO, REF) & where("chunk_type == 'parent'", index.read().columns))
    return here.groupBy().agg(F.lit(before).cast("long").alias("before"), F.lit(gone).cast("long").alias("gone"), F.lit(stale).cast("long").alias("stale"), F.count("*").alias("scanned"), F.lit(index.count()).cast("long").alias("counted"))


class CountingEmbedder:
    """Vectors of the number of characters and of blanks: an embedder that runs in the Python stage."""

    def id(self) -> str:
        return "counts"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]


def _synced(spark: SparkSession, sf_dir: str) -> tuple[IndexTable, list[tuple[str, Counts]]]:
    """A table after a first build and a sync of the changes, and what each step did."""
    index = create_store(spark, "parquet", scratch_folder(spark), {"buckets": 8})
    old, new = files(spark, sf_dir, "old"), files(spark, sf_dir, "new")
    todo = staged(change_set(old, new), "todo")
    changed = new.join(todo.where("status <> 'D'").select("path"), "path", "left_semi")
    steps = [("build", old.select("path"), old, "1"), ("sync", todo.select("path"), changed, "2")]
    done = [(name, refresh(index, paths, headed(rows), HeadingChunker(LARGE), CountingEmbedder(), REPO, REF, f"c{n}", f"t{n}")) for name, paths, rows, n in steps]
    return index, done


def q25_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table that a sync brought from the old to the new files."""
    index, _ = _synced(spark, sf_dir)
    return index.read().select("id", "path", "chunk_type", "content_commit", "seen_token", "content_hash", F.element_at("embedding", 1).cast("long").alias("n"))


def q26_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first build, a sync and a full rebuild count."""
    index, done = _synced(spark, sf_dir)
    new = files(spark, sf_dir, "new")
    done.append(("rebuild", refresh(index, new.select("path"), headed(new), HeadingChunker(LARGE), CountingEmbedder(), REPO, REF, "c2", "t3", full=True)))
    rows = [(name, c.added, c.updated, c.deleted, c.texts, c.tokens) for name, c in done]
    return spark.createDataFrame(rows, "step string, added long, updated long, deleted long, texts long, tokens long")


def q27_stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old files, then the changes, as two runs of a stream that keeps a table in step."""
    folder = scratch_folder(spark)
    index = create_store(spark, "parquet", f"{folder}/index", {"buckets": 8})
    old, new = files(spark, sf_dir, "old"), files(spark, sf_dir, "new")
    first = old.select("path", F.lit("A").alias("status"), "text", F.lit("1").alias("seq"))
    second = change_set(old, new).join(new.select("path", "text"), "path", "left").select("path", "status", "text", F.lit("2").alias("seq"))
    for number, changes in enumerate((first, second)):
        changes.write.parquet(f"{folder}/in{number}")
        stream = spark.readStream.schema(CHANGES).parquet(f"{folder}/in{number}")
        follow(stream, index, WholeFileChunker(), HashEmbedder(), REPO, REF, f"{folder}/progress{number}").awaitTermination()
    return index.read().select("path", "chunk_type", "content_hash")


def q28_section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections longer than a chunk may be: windows of whole lines of up to 1,000 characters, 100 of them shared."""
    rows = files(spark, sf_dir).select("path", F.concat(F.lit("# file\n"), py_strip(F.col("text"))).alias("text"))
    chunks = chunk_files(rows, HeadingChunker(1000, 100))
    return chunks.select("path", F.col("pos").cast("long").alias("pos"), "chunk_type", "heading_path", content_hash(F.col("text")).alias("content_hash"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

FILES = """
    docs AS (SELECT *, source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    old AS (SELECT path, text FROM docs WHERE doc_id % 10 <> 0),
    new AS (SELECT path, CASE WHEN doc_id % 10 = 2 THEN text || ' (edited)' ELSE text END AS text FROM docs WHERE doc_id % 10 <> 1),
    changes AS (
        SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status
        FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.text <> n.text
    )"""


def _ignored_sql(rules: list[tuple[str, bool]]) -> str:
    cases = " ".join(f"WHEN regexp_full_match(path, '{regex}') THEN {not negated}" for regex, negated in reversed(rules))
    return f"(CASE {cases} ELSE false END)"


OLD_SQL = _ignored_sql([("(.*/)?src1[^/]*(/.*)?", False), ("(.*/)?src12(/.*)?", True), ("src2/en(/.*)?", False), ("src4/.*(/.*)?", False)])
NEW_SQL = _ignored_sql([("(.*/)?src1[^/]*(/.*)?", False), ("(.*/)?src12(/.*)?", True), ("src14(/.*)?", True), ("src2/en(/.*)?", False), ("(.*/)?7[^/][.]md(/.*)?", False)])
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_NO_LF = SPACE.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")


def _strip_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\A[{SPACE}]+', ''), '[{SPACE}]+\z', '')"


TRAILING = f"'(?m)[{SPACE_NO_LF}]+$'"
CONVERSATIONS = """
    parts AS (SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
    conv AS (
        SELECT 'conv/' || conv_id || '.md' AS path, CASE conv_id % 3 WHEN 1 THEN '### note' || chr(10) || '## part' || chr(10) WHEN 2 THEN 'before' || chr(10) ELSE '' END
            || '# conv ' || conv_id || chr(10) || body AS text FROM parts
    ),
    lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM conv),
    heads AS (SELECT path, n, line, length(regexp_extract(line, '^(#{1,3})[ \\t]', 1)) AS level, trim(regexp_extract(line, '^#{1,3}[ \\t]+(.*)', 1)) AS title,
        row_number() OVER (PARTITION BY path ORDER BY n) AS i FROM lines WHERE regexp_matches(line, '^#{1,3}[ \\t]')),
    deep AS (SELECT *, least(i, i + min(level - i) OVER (PARTITION BY path ORDER BY n)) AS depth FROM heads),
    placed AS (
        SELECT path, n, line, level, concat_ws(' > ',
            CASE WHEN depth >= 1 THEN last_value(CASE WHEN depth = 1 THEN title END IGNORE NULLS) OVER w END,
            CASE WHEN depth >= 2 THEN last_value(CASE WHEN depth = 2 THEN title END IGNORE NULLS) OVER w END,
            CASE WHEN depth >= 3 THEN last_value(CASE WHEN depth = 3 THEN title END IGNORE NULLS) OVER w END) AS heading_path
        FROM deep WINDOW w AS (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING)
    )"""


def _key_sql(path: str, kind: str, heading: str, hash_: str, dup: str) -> str:
    return f"sha256(concat_ws(chr(0), '{REPO}', '{REF}', {path}, 'markdown-heading-v1', {kind}, {heading}, {hash_}, {dup}))"


def _rows_sql(name: str, source: str) -> str:
    """Chunks of headed files: the heading and the text with its lines' ends and its own ends stripped."""
    body = _strip_sql(f"regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {TRAILING}, '', 'g')")
    return f"""
    {name} AS (
        SELECT path, 'parent' AS chunk_type, '# file' AS text FROM {source}
        UNION ALL SELECT path, 'child', {body} FROM {source} WHERE {body} <> ''
    ),
    {name}_keyed AS (SELECT *, sha256(text) AS content_hash, {_key_sql("path", "chunk_type", "'file'", "sha256(text)", "'0'")} AS id FROM {name})"""


WINDOWS = f"""
        stripped AS (SELECT path, {_strip_sql("text")} AS text FROM docs),
        lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM stripped WHERE length(text) > 1000),
        sums AS (SELECT path, i, line, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) AS c1, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) - length(line) - 1 AS c0 FROM lines),
        ends AS (SELECT s.path, s.i, greatest(s.i + 1, (SELECT count(*) FROM sums t WHERE t.path = s.path AND t.c1 - s.c0 - 1 <= 1000)) AS e FROM sums s),
        nexts AS (
            SELECT e.path, e.i, e.e, coalesce(min(t.i), e.e) AS nx FROM ends e JOIN sums l ON l.path = e.path AND l.i = e.e - 1
            LEFT JOIN sums t ON t.path = e.path AND t.i > e.i AND t.i < e.e AND l.c1 - t.c0 <= 100 GROUP BY e.path, e.i, e.e
        ),
        walk(path, i, e, nx) AS (SELECT path, i, e, nx FROM nexts WHERE i = 0 UNION ALL SELECT n.path, n.i, n.e, n.nx FROM walk w JOIN nexts n ON n.path = w.path AND n.i = w.nx),
        texts AS (SELECT w.path, w.i, {_strip_sql("string_agg(l.line, chr(10) ORDER BY l.i)")} AS text FROM walk w JOIN lines l ON l.path = w.path AND l.i >= w.i AND l.i < w.e GROUP BY w.path, w.i),
        numbered AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS pos, text FROM texts WHERE text <> '')"""
BODY = _strip_sql(f"regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {TRAILING}, '', 'g')")
TOKENS = "CAST(coalesce(sum((strlen(text) + 3) // 4), 0) AS BIGINT)"
EDGES = """
    edges(commit_id, parent_id) AS (
        SELECT n_nationkey, n_nationkey - 3 FROM nation WHERE n_nationkey > 2
        UNION ALL SELECT n_nationkey, n_nationkey - 4 FROM nation WHERE n_nationkey % 5 = 4 AND n_nationkey > 4
        UNION ALL VALUES (100, 9), (101, 100)
    )"""

ORACLES: dict[str, str] = {
    "q01_snapshot_listing": f"WITH {FILES} SELECT DISTINCT path FROM docs",
    "q02_change_set": f"WITH {FILES} SELECT path, status FROM changes",
    "q30_tree_changes": f"WITH {FILES} SELECT path, status FROM changes",
    "q03_ignore_filter": f"WITH {FILES} SELECT path, status FROM changes WHERE status = 'D' OR NOT {NEW_SQL}",
    "q04_plan": f"""WITH {FILES}, todo AS (SELECT path, status FROM changes WHERE status = 'D' OR NOT {NEW_SQL})
        SELECT * FROM todo UNION ALL SELECT path, 'A' FROM new WHERE {OLD_SQL} AND NOT {NEW_SQL} AND path NOT IN (SELECT path FROM todo)""",
    "q05_normalize": rf"""WITH noisy AS (
            SELECT doc_id, '---' || chr(10) || 'key: 1' || chr(10) || '---' || chr(10) || replace(replace(text, '. ', '.' || chr(9) || chr(160) || ' ' || chr(13) || chr(10)), ', ', ', ' || chr(9) || '  ')
                || ' ' || chr(8195) || chr(13) AS t FROM documents
        ), ends AS (SELECT doc_id, regexp_replace(t, '\r\n?', chr(10), 'g') AS t FROM noisy),
        plain AS (SELECT doc_id, regexp_replace(t, {TRAILING}, '', 'g') AS t FROM ends),
        clean AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)\A---\n.*?\n---\n?', ''), {TRAILING}, '', 'g'), '[ \t]+', ' ', 'g') AS t FROM ends)
        SELECT doc_id, sha256(c.t) AS all_steps, sha256(p.t) AS default_steps, length(c.t) AS n FROM clean c JOIN plain p USING (doc_id)""",
    "q06_heading_paths": f"WITH {CONVERSATIONS} SELECT path, n AS line, trim(line) AS heading, level, heading_path FROM placed",
    "q07_heading_chunks": f"""WITH {CONVERSATIONS},
        owned AS (SELECT l.path, l.n, l.line, max(h.n) AS head FROM lines l JOIN heads h ON l.path = h.path AND h.n <= l.n GROUP BY l.path, l.n, l.line),
        bodies AS (SELECT path, head, {_strip_sql("string_agg(line, chr(10) ORDER BY n)")} AS text FROM owned WHERE n > head GROUP BY path, head),
        chunks AS (
            SELECT path, n AS head, 0 AS second, 'parent' AS chunk_type, heading_path, trim(line) AS text FROM placed
            UNION ALL SELECT b.path, head, 1, 'child', heading_path, text FROM bodies b JOIN placed p ON b.path = p.path AND b.head = p.n WHERE text <> ''
        )
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY head, second) - 1 AS pos, chunk_type, heading_path, sha256(text) AS content_hash FROM chunks""",
    "q08_sliding_windows": f"""WITH RECURSIVE {FILES}, {WINDOWS}
        SELECT path, pos, CASE pos WHEN 0 THEN 'parent' ELSE 'child' END AS chunk_type, sha256(text) AS content_hash FROM numbered
        UNION ALL SELECT path, 0, 'parent', sha256(text) FROM stripped WHERE text <> '' AND length(text) <= 1000""",
    "q32_long_file_windows": f"""WITH RECURSIVE docs AS (SELECT source AS path, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL GROUP BY source), {WINDOWS},
        every AS (SELECT path, pos, text FROM numbered UNION ALL SELECT path, 0, text FROM stripped WHERE text <> '' AND length(text) <= 1000)
        SELECT path, pos, CASE pos WHEN 0 THEN 'parent' ELSE 'child' END AS chunk_type, sha256(text) AS content_hash, row_number() OVER (PARTITION BY path, text ORDER BY pos) - 1 AS dup_index FROM every""",
    "q09_content_hash": f"WITH {FILES} SELECT path, 'parent' AS chunk_type, sha256({_strip_sql('text')}) AS content_hash FROM docs WHERE {_strip_sql('text')} <> ''",
    "q10_chunk_ids": f"""WITH {FILES}, bodies AS (SELECT path, {_strip_sql("text")} AS text FROM docs),
        chunks AS (
            SELECT path, 'parent' AS chunk_type, 'a' AS heading_path, '# a' AS text, '0' AS dup FROM bodies
            UNION ALL SELECT path, 'parent', 'a > b', '## b', dup FROM bodies, (VALUES ('0'), ('1')) AS d(dup)
            UNION ALL SELECT path, 'child', 'a > b', text, dup FROM bodies, (VALUES ('0'), ('1')) AS d(dup) WHERE text <> ''
        )
        SELECT {_key_sql("path", "chunk_type", "heading_path", "sha256(text)", "dup")} AS id, path, chunk_type, heading_path, sha256(text) AS content_hash FROM chunks""",
    "q11_new_or_known": f"""WITH {FILES}, changed AS (SELECT * FROM new WHERE path IN (SELECT path FROM changes)), {_rows_sql("was", "old")}, {_rows_sql("now", "changed")}
        SELECT id, path, CASE WHEN id IN (SELECT id FROM was_keyed) THEN 'update' ELSE 'add' END AS op FROM now_keyed""",
    "q12_merge": f"""WITH {FILES}, changed AS (SELECT * FROM new WHERE path IN (SELECT path FROM changes)), {_rows_sql("was", "old")}, {_rows_sql("now", "changed")},
        rows_ AS (
            SELECT id, path, chunk_type, 'c1' AS content_commit, 't1' AS seen_token, content_hash FROM was_keyed WHERE path NOT IN (SELECT path FROM changes)
            UNION ALL SELECT id, path, chunk_type, 'c2', 't2', content_hash FROM now_keyed
        )
        SELECT *, round(CAST(CAST(('0x' || substr(content_hash, 1, 2)) AS BIGINT) / 255.0 AS FLOAT)::DOUBLE, 6) AS first FROM rows_""",
    "q13_delete_and_count": f"WITH {FILES} SELECT count(*) AS before, count(*) FILTER (lang = 'en') AS deleted, count(*) FILTER (lang <> 'en') AS after FROM docs WHERE {_strip_sql('text')} <> ''",
    "q14_filter": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3",
    "q15_top_k": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) AS score FROM embeddings, q WHERE label <> 3
        ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10""",
    "q16_hash_embedding": "SELECT item_id, i AS place, round(CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS BIGINT) / 255.0, 9) AS value FROM benchmark, range(32) AS r(i)",
    "q17_commits_behind": f"""WITH RECURSIVE {EDGES},
        head(c) AS (SELECT 24 UNION SELECT parent_id FROM head JOIN edges ON commit_id = c),
        base(c) AS (SELECT 101 UNION SELECT parent_id FROM base JOIN edges ON commit_id = c)
        SELECT 'OUT_OF_DATE' AS state, count(*) AS commits_behind FROM head WHERE c NOT IN (SELECT c FROM base)""",
    "q18_verify": f"""WITH {FILES}, {_rows_sql("want", "docs")},
        idx AS (
            SELECT path, id FROM want_keyed WHERE id >= '1' UNION ALL SELECT path, 'x' || id FROM want_keyed WHERE id < '08' UNION ALL SELECT 'gone/' || path, id FROM want_keyed WHERE id < '08'
        ),
        missing AS (SELECT path, count(*) AS n FROM want_keyed WHERE (path, id) NOT IN (SELECT (path, id) FROM idx) GROUP BY path),
        stale AS (SELECT path, count(*) AS n FROM idx WHERE (path, id) NOT IN (SELECT (path, id) FROM want_keyed) AND path NOT LIKE 'gone/%' GROUP BY path)
        SELECT path, concat_ws(',', CASE WHEN m.n > 0 THEN 'MISSING' END, CASE WHEN s.n > 0 THEN 'STALE' END) AS issue, coalesce(m.n, 0) AS missing_count, coalesce(s.n, 0) AS stale_count
        FROM missing m FULL JOIN stale s USING (path) WHERE path NOT LIKE 'src5/%'
        UNION ALL SELECT path, 'STALE_DELETED', 0, count(*) FROM idx WHERE path LIKE 'gone/%' GROUP BY path
        UNION ALL SELECT DISTINCT path, 'IGNORED', 0, 0 FROM idx WHERE path LIKE 'src5/%'""",
    "q19_token_estimate": "SELECT lang, count(*) AS texts, sum(CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE (strlen(text) + 3) // 4 END)::BIGINT AS tokens FROM documents GROUP BY lang",
    "q20_top_k_each": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        scored AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(v.e, q.e) AS s FROM v q, v WHERE q.id % 20 = 0),
        best AS (SELECT query_id, id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM scored)
        SELECT * FROM best WHERE rank <= 10""",
    "q21_stream_replay": """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "q22_scalars": """SELECT doc_id, substr(sha256(text), 1, 8) AS short, lang || ':' || source AS model, CASE WHEN doc_id % 2 = 0 THEN 'UP TO DATE' ELSE 'other_state' END AS label,
        CASE WHEN doc_id % 3 <> 0 THEN source END AS filled FROM documents""",
    "q23_upsert_update": """WITH s AS (SELECT s_suppkey * 20 AS id, s_name AS name, 'SUPPLIER' AS segment FROM supplier),
        u AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT id FROM s) UNION ALL SELECT * FROM s)
        SELECT u.id, name, CASE WHEN p_partkey IS NULL THEN segment ELSE 'part ' || p_partkey END AS segment FROM u LEFT JOIN part ON p_partkey = u.id AND p_partkey % 7 = 0""",
    "q24_store": f"""WITH {FILES}, kept AS (SELECT path FROM docs WHERE {_strip_sql("text")} <> ''), rest AS (SELECT path FROM kept WHERE path NOT LIKE '%/fr/%')
        SELECT (SELECT count(*) FROM kept) AS before, (SELECT count(*) FROM kept WHERE path LIKE '%/fr/%') AS gone, 1 AS stale, count(*) - 1 AS scanned, count(*) - 1 AS counted FROM rest""",
    "q25_sync": f"""WITH {FILES}, changed AS (SELECT * FROM new WHERE path IN (SELECT path FROM changes)), {_rows_sql("was", "old")}, {_rows_sql("now", "changed")}
        SELECT id, path, chunk_type, 'c1' AS content_commit, 't1' AS seen_token, content_hash, length(text) AS n FROM was_keyed WHERE path NOT IN (SELECT path FROM changes)
        UNION ALL SELECT id, path, chunk_type, 'c2', 't2', content_hash, length(text) FROM now_keyed""",
    "q26_sync_counts": f"""WITH {FILES}, changed AS (SELECT * FROM new WHERE path IN (SELECT path FROM changes)), {_rows_sql("was", "old")}, {_rows_sql("now", "changed")}, {_rows_sql("every", "new")}
        SELECT 'build' AS step, count(*) AS added, 0 AS updated, 0 AS deleted, count(*) AS texts, {TOKENS} AS tokens FROM was_keyed
        UNION ALL SELECT 'sync', count(*), (SELECT count(*) FROM now_keyed WHERE id IN (SELECT id FROM was_keyed)),
            (SELECT count(*) FROM was_keyed WHERE path IN (SELECT path FROM changes) AND id NOT IN (SELECT id FROM now_keyed)), count(*), {TOKENS}
            FROM now_keyed WHERE id NOT IN (SELECT id FROM was_keyed)
        UNION ALL SELECT 'rebuild', count(*), 0, count(*), count(*), {TOKENS} FROM every_keyed""",
    "q27_stream_sync": f"WITH {FILES}, bodies AS (SELECT path, {BODY} AS text FROM new) SELECT path, 'parent' AS chunk_type, sha256(text) AS content_hash FROM bodies WHERE text <> ''",
    "q28_section_windows": f"""WITH RECURSIVE {FILES}, {WINDOWS}
        SELECT path, 0 AS pos, 'parent' AS chunk_type, 'file' AS heading_path, sha256('# file') AS content_hash FROM docs
        UNION ALL SELECT path, pos + 1, 'child', 'file', sha256(text) FROM numbered
        UNION ALL SELECT path, 1, 'child', 'file', sha256(text) FROM stripped WHERE text <> '' AND length(text) <= 1000""",
}
ORACLES["q34_many_rules"] = f"""WITH {FILES} SELECT path, CASE WHEN path LIKE '%9.md' OR regexp_full_match(path, 'src3/(.*/)?1[^/]*[.]md(/.*)?') THEN true
    WHEN doc_id < 10000 AND doc_id % 2 = 0 THEN false WHEN doc_id < 10000 AND path = 'src' || (doc_id % 20) || '/en/' || doc_id || '.md' THEN true ELSE {OLD_SQL} END AS ignored FROM docs"""
ORACLES["q33_verify_by_sketches"] = ORACLES["q18_verify"]
