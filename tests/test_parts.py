import asyncio

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.model import INDEX_SCHEMA, EmbeddingError
from strandline.operators.embed import HashEmbedder, embed_texts, is_transient, with_retry
from strandline.operators.search import results, top_k, top_k_each


class Failure(Exception):
    def __init__(self, text="", status_code=None):
        super().__init__(text)
        if status_code is not None:
            self.status_code = status_code


@pytest.mark.parametrize(("error", "transient"), [(Failure("Invalid API key"), False), (Failure("x", 401), False), (Failure("x", "422"), False), (Failure("x", 429), True), (Failure("x", 503), True), (ConnectionError(), True), (Failure("odd"), True)])
def test_errors(error, transient):
    assert is_transient(error) == transient


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise Failure("busy", 429)
        return "done"

    assert with_retry(flaky, 3, sleep=waits.append) == "done" and len(waits) == 3 and waits == sorted(waits)
    with pytest.raises(Failure):
        with_retry(lambda: (_ for _ in ()).throw(Failure("no", 400)), 3, sleep=waits.append)
    assert len(waits) == 3


class Async(HashEmbedder):
    running = most = 0

    async def async_embed(self, texts):
        Async.running += 1
        Async.most = max(Async.most, Async.running)
        await asyncio.sleep(0.01)
        Async.running -= 1
        return self.embed(texts)


def test_overlapping_calls_keep_order_and_bound():
    texts = [str(i) for i in range(50)]
    vectors, calls = embed_texts(Async(), texts, 5, 3)
    assert vectors == HashEmbedder().embed(texts) and calls == 10 and Async.most == 3
    assert embed_texts(HashEmbedder(), texts, 64)[1] == 1


def test_missing_vectors_are_an_error():
    class Short(HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[1:]

    with pytest.raises(EmbeddingError):
        embed_texts(Short(), ["a", "b"])


def test_ties_go_by_id_and_odd_vectors_score_zero(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", None)]
    index = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert [(r["id"], r["score"]) for r in top_k(index, [1.0, 0.0], 9).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 0.0)]
    assert top_k(index, [1.0, 0.0], 0).count() == 0


def test_blocks_of_queries_equal_single_ones(spark):
    index = spark.range(200).select("id", F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) / 100.0).cast("float") for i in range(8)]).alias("embedding"))
    queries = index.where("id < 7").withColumnRenamed("id", "query_id")
    found = {(r["query_id"], r["rank"]): r["id"] for r in top_k_each(index, queries, 5, block_bytes=128).collect()}
    for q in queries.collect():
        for n, r in enumerate(top_k(index, q["embedding"], 5).collect(), 1):
            assert found[q["query_id"], n] == r["id"]


def test_rows_without_text_are_no_result(spark):
    rows = [tuple(f"{f.name}" for f in INDEX_SCHEMA if f.name != "embedding") + ([1.0],), ("x", "r", "m", "p", "", "parent", " ", "c", "t", "s", "h", [1.0])]
    assert results(top_k(spark.createDataFrame(rows, INDEX_SCHEMA), [1.0], 5)).count() == 1


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 3), max_size=6), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 3), max_size=6))
def test_merge_equals_a_rebuild(spark, old, new):
    from strandline.operators.chunk import HeadingChunker, expected_rows
    from strandline.operators.delta import change_set
    from strandline.operators.embed import embed_rows
    from strandline.operators.merge import merged, new_rows

    def snapshot(files):
        rows = [(p, f"# same\n{v}\n## {p}\n", str(v)) for p, v in files.items()]
        return spark.createDataFrame(rows, "path string, text string, content_hash string")

    def expected(files, commit):
        return expected_rows(files, HeadingChunker(), None, "r", "m", commit, commit)

    a, b = snapshot(old), snapshot(new)
    index = embed_rows(expected(a, "1"), HashEmbedder()).drop("calls")
    todo = change_set(a, b)
    wanted = expected(b.join(todo.where("status <> 'D'").select("path"), "path", "left_semi"), "2")
    after = merged(index, embed_rows(new_rows(wanted, index), HashEmbedder()), wanted, todo)
    ids = sorted(r["id"] for r in after.select("id").collect())
    assert ids == sorted(r["id"] for r in expected(b, "2").select("id").collect())


def test_stream_equals_batch(spark, tmp_path):
    from strandline.operators.chunk import WholeFileChunker
    from strandline.sources.table import IndexTable
    from strandline.streaming.replay import CHANGES, follow

    rows = [[("a", "A", "one", "1"), ("b", "A", "two", "2")], [("a", "M", "three", "3"), ("b", "D", None, "4"), ("c", "A", "four", "5")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    table = IndexTable(spark, (tmp_path / "index").as_uri(), 4)
    for i in range(2):
        changes = spark.readStream.schema(CHANGES).parquet(str(tmp_path / f"in{i}"))
        follow(changes, table, WholeFileChunker(), HashEmbedder(), "r", "m", str(tmp_path / f"progress{i}")).awaitTermination()
    assert {(r["path"], r["text"]) for r in table.read().collect()} == {("a", "three"), ("c", "four")}
    assert table.count() == 2


def test_json_export_and_import(spark, tmp_path):
    from strandline.sources.table import export_json, import_json

    (tmp_path / "old.json").write_text('{"docs": [{"id": "1", "text": "a"}, {"id": "1", "text": "b"}, {"text": "no id"}, {"id": "2", "embedding": [0.5]}]}')
    rows = import_json(spark, str(tmp_path / "old.json"))
    assert {(r["id"], r["text"]) for r in rows.collect()} == {("1", "b"), ("2", None)}
    export_json(rows, str(tmp_path / "out"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["1", "2"]


def test_last_of_repeated_ids_wins_and_an_own_hash_embedder_is_called(spark):
    from strandline.operators.embed import embed_rows
    from strandline.operators.merge import upsert

    index = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d"), (2, "e")], "id long, v string").coalesce(1)
    assert sorted(tuple(r) for r in upsert(index, rows).collect()) == [(1, "a"), (2, "e"), (3, "d")]

    class Own(HashEmbedder):
        def embed(self, texts):
            return [[7.0] for _ in texts]

    Own.__name__ = "HashEmbedder"
    found = embed_rows(spark.createDataFrame([("x",)], "text string"), Own()).first()
    assert list(found["embedding"]) == [7.0] and found["calls"] == 1


def test_upsert_takes_the_last_by_its_order(spark):
    from strandline.operators.merge import upsert

    index = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, v int, seq int")
    rows = spark.createDataFrame([("a", 2, 9), ("a", 3, 4), ("c", 5, 1)], "id string, v int, seq int").repartition(3)
    found = upsert(index, rows, F.col("seq")).select("id", "v").collect()
    assert sorted(tuple(r) for r in found) == [("a", 2), ("b", 1), ("c", 5)]

