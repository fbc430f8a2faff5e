"""Approximate search by codes: recall against exact search, bytes read, and the codes of a table that changes."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.model import INDEX_SCHEMA
from strandline.operators.graph import build_graph, graph_top_k_each
from strandline.operators.search import top_k, top_k_each
from strandline.operators.vector_index import Model, VectorIndex, unit
from strandline.queries import QUERIES
from strandline.sources.table import IndexTable

SF = "/root/testdata/sf0.1"


def test_recall_over_every_twentieth_row_with_a_fraction_of_the_bytes(spark):
    found = {(r["query_id"], r["id"]) for r in QUERIES["q29_vector_index"](spark, SF).collect()}
    exact = {(f"v{r['query_id']}", f"v{r['id']}") for r in QUERIES["q20_top_k_each"](spark, SF).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)


def test_codes_are_a_small_part_and_few_vectors_are_compared(spark, tmp_path):
    index = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit("p").alias("path"), "embedding")
    codes = VectorIndex(spark, (tmp_path / "codes").as_uri())
    codes.build(index)
    n = index.count()
    assert codes.codes().count() == n and len(codes.codes().first()["code"]) * 8 == 64 * 4
    queries = index.where("id % 200 = 0").select(F.col("id").alias("query_id"), "embedding")
    # a hundred vectors a query: a twentieth of the rows
    assert codes.candidates(queries, 100).groupBy("query_id").count().agg(F.max("count")).first()[0] == 100 <= n / 5
    # with all cells and all candidates it is exact
    exact = {(r["query_id"], r["id"], r["rank"]) for r in top_k_each(index, queries, 10).collect()}
    every = codes.top_k_each(index, queries, 10, share=1.0, first=n)
    assert {(r["query_id"], r["id"], r["rank"]) for r in every.collect()} == exact


def test_cells_hold_the_share_that_is_asked_for():
    x = np.random.default_rng(1).normal(size=(500, 6))
    model = Model.fit(x, 20)
    for share in (0.01, 0.3, 1.0):
        held = model.probed(x, share) @ model.share
        assert (held >= min(share, 1 - 1e-9)).all() and held.mean() <= share + model.share.max() + 1e-9
    cell, codes = model.code(x)
    close = (np.vstack([model.decoded(c, k[None, :]) for c, k in zip(cell, codes, strict=True)]) * unit(x)).sum(axis=1)
    assert close.mean() > 0.95
    Model.fit(np.ones((3, 4)), 2).code(np.ones((2, 4)))  # rows that are all alike


def row(n, vector, ref="main"):
    return (f"id{n}", "repo", ref, f"d/{n}.md", "", "parent", f"text {n}", "c", "t", "s", "h", vector)


def test_codes_follow_a_table(spark, tmp_path):
    rng = random.Random(4)

    def vectors(ns):
        return [row(n, [rng.gauss(0, 1) for _ in range(16)], "main" if n % 3 else "other") for n in ns]

    table = IndexTable(spark, (tmp_path / "table").as_uri(), 4)
    codes = VectorIndex(spark, f"{table.path}/vectors")
    assert codes.version is None
    odd = [row(9001, None), row(9002, []), row(9003, [1.0, 2.0]), row(9004, [0.0] * 16)]
    table.commit(spark.createDataFrame(vectors(range(400)) + odd, INDEX_SCHEMA), table.manifest())
    codes.follow(table)
    assert codes.version == 1 and codes.codes().count() == 400
    gone = table.read(places=True).where("id in ('id1', 'id2', 'id5')").select("_file", "_row")
    table.change(spark.createDataFrame(vectors(range(400, 430)), INDEX_SCHEMA), gone, table.manifest())
    assert codes.version == 1
    codes.follow(table)
    assert codes.version == 2 and codes.codes().count() == 430 and len(codes._folders()) == 1
    predicate = F.col("ref") == "main"
    hits = 0
    for n in (7, 401, 1):
        vector = [float(v) for v in (table.read().where(F.col("id") == f"id{n}").first() or table.read().first())["embedding"]]
        exact = [r["id"] for r in top_k(table.read(), vector, 10, predicate).collect()]
        near = codes.rows_near(table, vector, 10, predicate)
        got = [r["id"] for r in top_k(table.read() if near is None else near, vector, 10, predicate).collect()]
        assert len(got) == 10 and not {"id1", "id2", "id5"} & set(got)
        hits += len(set(got) & set(exact))
    assert hits >= 27
    # a predicate that few rows match asks for more candidates, in the end for all rows
    few = F.col("id").isin("id3", "id405")
    near = codes.rows_near(table, vector, 2, few)
    assert {r["id"] for r in top_k(table.read() if near is None else near, vector, 2, few).collect()} == {"id3", "id405"}
    assert codes.rows_near(table, [1.0], 2, predicate) is None
    # a table that changes as a whole is coded anew
    table.commit(spark.createDataFrame(vectors(range(1000, 1100)), INDEX_SCHEMA), table.manifest())
    codes.follow(table)
    assert codes.codes().count() == 100 and len(codes._folders()) == 2


def test_walks_over_the_graph_find_what_exact_search_finds(spark):
    found = {(r["query_id"], r["id"]) for r in QUERIES["q31_proximity_graph"](spark, SF).collect()}
    exact = {(r["query_id"], r["id"]) for r in QUERIES["q20_top_k_each"](spark, SF).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)


def test_a_graph_in_parts_with_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"r{n}", [rng.gauss(0, 1) for _ in range(8)]) for n in range(300)] + [("none", None), ("empty", []), ("zero", [0.0] * 8), ("short", [1.0])] + [(f"same{n}", [1.0] * 8) for n in range(40)]
    index = spark.createDataFrame(rows, "id string, embedding array<float>")
    path = (tmp_path / "graph").as_uri()
    build_graph(index, path, part_rows=120)
    graph = spark.read.parquet(path)
    assert graph.count() == 340 and graph.select("part").distinct().count() == 3
    part = {r["node"]: r["part"] for r in graph.collect()}
    assert all(part[v] == r["part"] and v != r["node"] for r in graph.collect() for v in r["near"] or [])
    queries = index.where("id in ('r1', 'r2', 'r3', 'same1', 'short')").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in top_k_each(index.where("id like 'r%' or id like 'same%'"), queries.where("query_id <> 'short'"), 5).collect()}
    found = {(r["query_id"], r["id"]) for r in graph_top_k_each(spark, path, queries, 5, beam=200).collect()}
    assert {q for q, _ in found} == {"r1", "r2", "r3", "same1"}
    random_ones = {x for x in exact if x[0] != "same1"}
    assert len(found & random_ones) >= 0.9 * len(random_ones) and all(i.startswith("same") for q, i in found if q == "same1")
    build_graph(index.limit(0), path + "-none")
    assert graph_top_k_each(spark, path + "-none", queries, 5).count() == 0



def test_a_graph_is_dealt_out_once_for_all_blocks_of_queries(spark, tmp_path, monkeypatch):
    from strandline.operators import graph

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    graph.build_graph(rows, str(tmp_path / "graph"))
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in graph.graph_top_k_each(spark, str(tmp_path / "graph"), queries, 5).select("query_id", "id", "rank").collect()}
    dealt, kind = [], type(rows)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: (dealt.append(a), plain(self, *a))[1])
    monkeypatch.setattr(graph, "BLOCK_BYTES", 2_000)
    assert {tuple(r) for r in graph.graph_top_k_each(spark, str(tmp_path / "graph"), queries, 5).select("query_id", "id", "rank").collect()} == whole
    assert dealt == [("part",)]
