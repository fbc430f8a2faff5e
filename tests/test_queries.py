import pytest
from compare import same
from pyspark.sql import functions as F

from strandline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_inverted_file_is_exact_with_all_cells_and_finds_most_with_some(spark):
    from pyspark.sql import functions as F

    from strandline.operators.search import approximate_top_k, approximate_top_k_each, cells, inverted_file, top_k, with_cell
    from strandline.sources.scratch import scratch_folder

    index = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    vector = index.where("id = 3").first()["embedding"]
    centres = cells(index)
    exact = [r["id"] for r in top_k(index, vector, 10).collect()]
    assert [r["id"] for r in approximate_top_k(with_cell(index, centres), centres, vector, 10, probes=99).collect()] == exact
    folder = scratch_folder(spark)
    centres = inverted_file(index, folder)
    celled = spark.read.parquet(folder)
    assert celled.count() == index.count() and "PartitionFilters: [isnotnull(cell" in approximate_top_k(celled, centres, vector, 10)._jdf.queryExecution().toString().replace("PartitionFilters: [cell", "PartitionFilters: [isnotnull(cell")
    queries = index.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    every = approximate_top_k_each(celled, centres, queries, 10, probes=16)
    wanted = {(r["query_id"], r["id"]) for r in QUERIES["q20_top_k_each"](spark, "/root/testdata/sf0.01").collect()}
    assert {(r["query_id"], r["id"]) for r in every.collect()} == wanted
    some = {(r["query_id"], r["id"]) for r in QUERIES["q20b_inverted_file"](spark, "/root/testdata/sf0.01").collect()}
    assert len(some & wanted) >= 0.95 * len(wanted)
    # many blocks of queries give what one gives
    few = approximate_top_k_each(celled, centres, queries, 10, probes=16, block_bytes=2000)
    assert {(r["query_id"], r["id"]) for r in few.collect()} == wanted


def test_a_task_holds_few_scores_at_once_and_finds_what_brute_force_finds():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from strandline.operators.search import _best_of_each

    rng = np.random.default_rng(5)
    rows, asked = rng.normal(size=(6_000, 8)), rng.normal(size=(3_000, 8))
    rows[10:20] = rows[5]  # ties, which go by id
    batch = pa.RecordBatch.from_arrays([pa.array(range(6_000)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])
    tracemalloc.start()
    [found] = _best_of_each(pa.array(range(3_000)), asked, 10)(iter([batch, batch.slice(0, 0)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all scores at once are 144 MB
    score = asked @ rows.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(rows, axis=1)
    best = np.lexsort((np.broadcast_to(np.arange(6_000), score.shape), -score.round(9)), axis=1)[:, :10]
    assert [sorted(x) for x in np.array(found["id"]).reshape(3_000, 10).tolist()] == [sorted(x) for x in best.tolist()]


def test_a_cell_that_most_queries_probe_is_scored_piece_by_piece():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from strandline.operators.search import _best_of_each

    rng = np.random.default_rng(6)
    rows, asked, cell = rng.normal(size=(6_000, 8)), rng.normal(size=(3_000, 8)), np.arange(6_000) % 20 == 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(6_000)), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(cell.astype(int))], names=["id", "embedding", "cell"])
    probed = np.stack([np.arange(3_000) % 10 > 0, np.arange(3_000) % 10 == 0], axis=1)
    tracemalloc.start()
    [found] = _best_of_each(pa.array(range(3_000)), asked, 10, probed)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # the scores of the large cell at once are 123 MB
    score = asked @ rows.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(rows, axis=1)
    score[~probed[:, cell.astype(int)]] = -2
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert np.array(found["id"]).reshape(3_000, 10).tolist() == best.tolist()


def test_batches_of_long_texts_are_taken_piece_by_piece():
    import pyarrow as pa

    from strandline.functions.batches import in_pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array(["x" * 40_000] * 2_000)], names=["id", "text"])
    cut = list(in_pieces(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert [i for piece in cut for i in piece["id"].to_pylist()] == [*range(2_000), 0]
    assert max(piece.nbytes for piece in cut) < 5_000_000 and max(piece.num_rows for piece in in_pieces(iter([batch.select(["id"])]))) == 500


def test_long_files_reach_the_chunker_in_small_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandline.operators import chunk

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(batch.nbytes)]), *(pa.array([x], t) for x, t in ((0, pa.int32()), ("", pa.string()), ("", pa.string()), ("x", pa.string()), (0, pa.int32())))], names=["path", "pos", "chunk_type", "heading_path", "text", "dup_index"])

    monkeypatch.setattr(chunk, "releasing", lambda run: told)
    files = spark.range(0, 1_000, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 20_000).alias("text"))
    sizes = [int(r["path"]) for r in chunk.chunk_files(files, chunk.WholeFileChunker()).collect()]
    assert sum(sizes) > 20_000_000 and max(sizes) < 4_000_000  # one batch of 20 MB before


def test_a_stream_of_changes_is_not_written_by_one_task(spark, monkeypatch):
    asked = []
    kind = type(spark.range(1))
    plain = kind.coalesce
    monkeypatch.setattr(kind, "coalesce", lambda self, n: (asked.append((n, self.columns)), plain(self, n))[1])
    QUERIES["q27_stream_sync"](spark, "/root/testdata/sf0.001").count()
    assert not [n for n, columns in asked if "text" in columns]


def test_a_task_of_many_queries_keeps_little_for_each():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from strandline.operators.search import _best_of_each

    rng = np.random.default_rng(8)
    rows, asked, known = rng.normal(size=(4_000, 8)), rng.normal(size=(6_000, 8)), {}
    rows[7], rows[11:15], asked[3] = 0, rows[10], 0  # a vector without a direction scores 0, equal ones go by id
    vectors = rows.tolist()
    vectors[20] = [1.0]  # of another length: 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(1 << 40, (1 << 40) + 4_000)), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "embedding"])
    tracemalloc.start()
    [found] = _best_of_each(pa.array(range(6_000)), asked, 10)(iter([batch.slice(0, 2_500), batch.slice(2_500)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows[20] = 0
    size = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
    score = np.divide(asked @ rows.T, size, out=np.zeros_like(size), where=size > 0)
    best = np.lexsort((np.broadcast_to(np.arange(4_000), score.shape), -score.round(12)), axis=1)[:, :10]
    for query, row in zip(found["query_id"].to_pylist(), found["id"].to_pylist(), strict=True):
        known.setdefault(query, []).append(row - (1 << 40))
    assert all(sorted(known[q]) == sorted(best[q].tolist()) for q in range(6_000))
    assert peak < 20e6  # 37 MB before


def test_reachability_ends_on_cycles_and_long_histories(spark):
    from strandline.operators.lineage import ahead, reachable

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, None), *((i, i - 1) for i in range(40, 30, -1))], "commit_id long, parent_id long")
    starts = spark.createDataFrame([(1,), (40,), (9,), (None,)], "start long")
    found = {(r[0], r[1]) for r in reachable(edges, starts).collect()}
    assert found == {(1, 1), (1, 2), (1, 3), (9, 9), *((40, i) for i in range(30, 41))}
    assert {r[0] for r in ahead(edges, 35, 40).collect()} == {36, 37, 38, 39, 40}


def test_a_long_history_takes_logarithmic_rounds_and_merges_stay_bounded(spark):
    import random

    from strandline.operators.lineage import reachable

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("history", "a chain of 10,000 commits")
    chain = spark.range(1, 10_000).select(F.col("id").alias("commit_id"), (F.col("id") - 1).alias("parent_id"))
    found = reachable(chain, spark.createDataFrame([(9_999,), (5,)], "start long"))
    rounds = sum("/reached-" in f for f in {f.rsplit("/", 1)[0] for f in found.inputFiles()})
    assert found.count() == 10_006 and rounds <= 2 * 14
    assert len(tracker.getJobIdsForGroup("history")) < 400
    spark.sparkContext.setJobGroup("", "")
    rng = random.Random(2)
    edges = [(i, rng.randrange(max(0, i - 9), i)) for i in range(1, 200) for _ in range(rng.choice([1, 1, 2, 3]))]
    graph = spark.createDataFrame(edges, "commit_id long, parent_id long")
    for growth in (0, 1, 1000):  # never longer jumps, some, always
        got = {(r[0], r[1]) for r in reachable(graph, spark.createDataFrame([(199,), (60,)], "start long"), growth).collect()}
        wanted = set()
        for start in (199, 60):
            todo = [start]
            while todo:
                at = todo.pop()
                if (start, at) not in wanted:
                    wanted.add((start, at))
                    todo += [p for c, p in edges if c == at]
        assert got == wanted


def test_filter_reaches_the_scan(spark):
    from strandline.functions.predicates import of_ref
    from strandline.model import INDEX_SCHEMA
    from strandline.sources.scratch import scratch_folder

    folder = scratch_folder(spark)
    spark.createDataFrame([], INDEX_SCHEMA).write.parquet(folder)
    plan = spark.read.parquet(folder).where(of_ref("r", "main")).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(repo_id,r)" in plan and "EqualTo(ref,main)" in plan
