import re
from pathlib import Path

import pytest

import corpus_pipeline
from strandline.llm.common import written


def test_stages_in_order(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    folder, read = sf
    docs = read("documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, folder), name)
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
            counts.append(after.count())
        else:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "exact_dedup":
            assert after.count() == docs.select("text").distinct().count()
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_odd_rows_pass_all_stages(spark, odd, sf):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, docs, sf[0]), name)
            if name != "packing":
                assert after.columns == odd.columns and after.count() <= docs.count()
            docs = after
        assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").distinct().collect())
    assert not ids


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("strandline/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts and path.exists():
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_registered(name):
    import __spark_entry__ as e

    assert sum(q.startswith(name) for q in e.queries()) == 1
