import dataclasses
import json
import sys

import pytest
from pyspark import cloudpickle

from strandline.cli import answer, parser, run
from strandline.model import EmbeddingError, GitError, LockError, StrandlineError
from strandline.operators.embed import HashEmbedder
from strandline.plans.engine import Index
from strandline.sources.state import read_json, single_writer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the embedder below goes to the workers

FILES = {
    "docs/guide.md": "# Guide\nintro\n## Install\nrun it\n## Use\ncall it\n",
    "docs/faq.md": "# FAQ\n## Why\nbecause\n",
    "src/main.py": "print('hello')\n",
    "notes.txt": "plain note\n",
}


class Counting:
    """An embedder that counts, and fails when told to; not the built-in one, so it runs in the Python stage."""

    def __init__(self, folder, fail=False):
        self.folder, self.fail = str(folder), fail

    def id(self):
        return "counting"

    def embed(self, texts):
        import pathlib
        import uuid

        if self.fail:
            raise ValueError("unauthorized")
        pathlib.Path(self.folder, uuid.uuid4().hex).write_text(str(len(texts)))
        return HashEmbedder().embed(texts)


@pytest.fixture
def index(spark, repo):
    repo.commit(FILES)
    made = Index(spark, repo.root)
    made.init()
    return made


def ids(index):
    return {r["id"]: r["path"] for r in index.as_dataframe().select("id", "path").collect()}


def test_init_refuses_a_second_time_unless_forced(index):
    with pytest.raises(StrandlineError):
        index.init()
    assert index.init(force=True, chunker="sliding-window").chunker == "sliding-window"


def test_no_repository_is_exit_code_2(spark, tmp_path):
    with pytest.raises(GitError) as error:
        Index(spark, tmp_path).init()
    assert error.value.exit_code == 2


def test_unknown_parts_are_errors_not_fallbacks(index):
    index.init(force=True, chunker="nonsense")
    with pytest.raises(StrandlineError):
        index.sync()
    index.init(force=True, embedder="nowhere:x")
    with pytest.raises(EmbeddingError):
        index.sync()


def test_full_then_incremental_equals_rebuild(index, repo):
    first = index.sync()
    assert (first.files_processed, first.chunks_added, first.from_commit) == (4, 11, None)
    assert first.stats.embedded_texts == 11
    again = index.sync()
    assert again.already_up_to_date
    repo.commit({"docs/guide.md": FILES["docs/guide.md"].replace("call it", "call it twice"), "src/main.py": None, "new.md": "# New\nbody\n"})
    plan = index.sync(dry_run=True)
    assert plan.planned_files == ["docs/guide.md", "new.md", "src/main.py"] and plan.dry_run
    second = index.sync()
    assert (second.files_processed, second.chunks_added, second.chunks_updated, second.chunks_deleted) == (3, 3, 5, 2)
    assert second.stats.embedded_texts == 3
    incremental = ids(index)
    rebuilt = index.sync(full=True)
    assert rebuilt.chunks_added == len(incremental) and rebuilt.chunks_deleted == len(incremental)
    assert ids(index) == incremental


def test_update_keeps_the_embedding_and_moves_the_commit(index, repo):
    index.sync()
    before = {r["id"]: r["embedding"] for r in index.as_dataframe().collect()}
    head = repo.commit({"docs/faq.md": FILES["docs/faq.md"] + "more\n"})
    index.sync()
    rows = {r["id"]: r for r in index.as_dataframe().where("path = 'docs/faq.md'").collect()}
    kept = [r for i, r in rows.items() if i in before]
    assert kept and all(r["content_commit"] == head and r["embedding"] == before[r["id"]] for r in kept)


def test_interrupted_sync_leaves_no_trace_and_is_resumed(spark, repo, tmp_path):
    repo.commit(FILES)
    calls = tmp_path / "calls"
    calls.mkdir()
    broken = Index(spark, repo.root, embedder=Counting(calls, fail=True))
    broken.init()
    with pytest.raises(Exception, match="unauthorized"):
        broken.sync()
    assert broken.status().state == "INTERRUPTED"
    assert not broken.table(broken.config()).exists
    target = read_json(broken.state / "txn.json")["to_commit"]
    repo.commit({"late.md": "# Late\n"})
    mended = Index(spark, repo.root, embedder=Counting(calls))
    result = mended.sync()
    assert result.recovered and result.to_commit == target
    assert "late.md" not in ids(mended).values()
    assert sum(int(f.read_text()) for f in calls.iterdir()) == result.chunks_added == 11
    assert mended.status().state == "OUT_OF_DATE" and mended.status().commits_behind == 1
    mended.sync()
    assert mended.status().state == "UP_TO_DATE"


def test_ignore_rules_and_readmission(index, repo):
    repo.commit({".strandlineignore": "src/\n"})
    index.sync()
    assert "src/main.py" not in ids(index).values()
    repo.commit({".strandlineignore": "# none\n"})
    assert index.sync().files_processed_paths == ["src/main.py"]
    repo.commit({".strandlineignore": "*.txt\n"})
    index.sync()
    assert "notes.txt" in ids(index).values()  # only verify removes it
    report = index.verify(all=True)
    assert report.ignored_stale == ["notes.txt"] and not report.all_passed
    assert index.verify(all=True, fix=True).all_passed
    assert "notes.txt" not in ids(index).values()


def test_changed_parts_need_a_full_sync(index, spark, repo, tmp_path):
    index.sync()
    other = Index(spark, repo.root, embedder=Counting(tmp_path))
    repo.commit({"x.md": "# X\n"})
    with pytest.raises(StrandlineError, match="full"):
        other.sync()
    assert other.sync(full=True).chunks_added == 12


def test_query(index):
    with pytest.warns(RuntimeWarning):
        assert index.query("hello") == []
    index.sync()
    found = index.query("print('hello')", k=3)
    assert found[0].path == "src/main.py" and found[0].score == pytest.approx(1.0)
    assert len(found) == 3 and index.query("x", k=0) == []
    assert {r.path for r in index.query("x", k=9, filter_expr="path == 'docs/faq.md'")} == {"docs/faq.md"}
    with pytest.raises(StrandlineError):
        index.query("  ")
    with pytest.raises(StrandlineError):
        index.query("x", filter_expr="score > 1")


def test_verify_finds_and_mends(index, repo):
    with pytest.raises(StrandlineError):
        index.verify()
    index.sync()
    assert index.verify(all=True).all_passed
    table = index.table(index.config())
    from pyspark.sql import functions as F

    assert table.delete_where(F.col("chunk_type") == "child") == 4
    report = index.verify(all=True)
    failed = {c["path"]: c for c in report.file_checks if c["status"] == "FAIL"}
    assert set(failed) == {"docs/guide.md", "docs/faq.md"} and failed["docs/guide.md"]["missing_count"] == 3
    mended = index.verify(all=True, fix=True)
    assert mended.all_passed and mended.fixed
    assert len(index.verify(sample=2).file_checks) == 2


def test_check_and_status(index):
    assert index.check().all_passed and index.check().embedder["dimension"] == 32
    assert index.status().state == "NOT_SYNCED"
    index.sync()
    assert index.check().vectorstore["doc_count"] == 11


def test_one_writer(index):
    index.sync()
    with single_writer(index.state / "lock"), pytest.raises(LockError) as error:
        index.sync(full=True)
    assert error.value.exit_code == 3


def test_old_versions_go(index, repo):
    index.sync()
    repo.commit({"notes.txt": "other\n"})
    index.sync()
    before = ids(index)
    index.table(index.config()).vacuum(keep=1)
    assert ids(index) == before


def test_command_line(index, capsys):
    for argv, code in ((["sync", "--format", "json"], 0), (["--format", "json", "sync"], 0), (["query", "hello", "--k", "1", "--format", "jsonl"], 0), (["status"], 0), (["verify", "--all"], 0), (["check", "-q"], 0)):
        assert run(index, parser().parse_args(argv)) == code
        out = capsys.readouterr().out
        if "json" in " ".join(argv):
            json.loads(out)
        assert ("-q" in argv) == (out == "")
    found = index.query("hello", k=2)
    envelope = json.loads(answer(found, "hello", None, "json", False))
    assert [r["rank"] for r in envelope["results"]] == [1, 2] and envelope["query"] == "hello"
    assert answer(found, "hello", None, "text", True).startswith(f"{found[0].score:.4f}  {found[0].path}")
    assert answer([], "hello", None, "text", True) == "nothing found"
    assert run(index, parser().parse_args(["status", "--format", "jsonl"])) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1


def test_reports(index):
    from strandline.report import MARKER, ci_outputs, markdown, output_lines

    result = dataclasses.asdict(index.sync())
    verify = dataclasses.asdict(index.verify(all=True))
    text = markdown(result, verify=verify)
    assert text.startswith(MARKER) and "11 chunks added" in text and "verification passed" in text and '"notes.txt"' in text
    many = markdown(result | {"files_processed_paths": [str(i) for i in range(30)], "files_processed": 300})
    assert "and 280 more" in many and "verification not run" in many
    outputs, code = ci_outputs(result, None, verify)
    assert code == 0 and outputs["chunks-added"] == "11" and outputs["verify-passed"] == "true"
    assert "sync-result<<END\ncompleted\nEND\n" in output_lines(outputs)
    failed, code = ci_outputs(None, "boom END", None)
    assert code == 1 and failed["sync-result"] == "error" and "comment-body<<END_\n" in output_lines(failed)


def test_queries_by_the_vector_index(spark, repo):
    index = Index(spark, repo.root)
    repo.commit(FILES)
    index.init()
    config = index.config()
    config["vectorstore"]["options"] = {"buckets": 4, "approximate": True}
    from strandline.sources.state import write_config

    write_config(index.state / "config.yaml", config)
    index.sync()
    for text in ("call it", "main"):
        assert [r.doc_id for r in index.query(text, 3)] == [r.doc_id for r in index.query(text, 3, approximate=False)]
    repo.commit({"new.md": "# New\nentirely new body\n"})
    index.sync()
    assert index.query("# New", 1)[0].path == "new.md"


def test_a_commit_diff_opens_only_directories_that_changed(spark, repo):
    from strandline.sources.snapshot import GitSource

    files = {f"d{a}/e{b}/f{c}.md": f"{a} {b} {c}" for a in range(6) for b in range(4) for c in range(3)} | {"x": "file", "odd näme/ü": "u"}
    first = repo.commit(files)
    source = GitSource.discover(repo.root)
    assert {(r["path"], r["status"]) for r in source.changes(spark, None, first)[0].collect()} == {(p, "A") for p in files}
    assert {r["path"] for r in source.tree(spark, first).collect()} == set(files)
    (repo.root / "x").unlink()
    second = repo.commit({"d1/e2/f0.md": "new", "d1/e2/f9.md": "more", "d3/e0/f1.md": None, "x/y/z": "a directory now"})
    changes, compared = source.changes(spark, first, second)
    assert {(r["path"], r["status"]) for r in changes.collect()} == {("d1/e2/f0.md", "M"), ("d1/e2/f9.md", "A"), ("d3/e0/f1.md", "D"), ("x", "D"), ("x/y/z", "A")}
    assert {r["path"] for r in compared.collect()} == {"d1", "d1/e2", "d3", "d3/e0", "x", "x/y"}
    assert source.changes(spark, second, second)[0].count() == 0


def test_directory_hashes_find_what_the_full_join_finds(spark):
    from strandline.operators.delta import change_set, tree_changes, with_directories

    rng = __import__("random").Random(3)
    old = {f"a{rng.randrange(4)}/b{rng.randrange(4)}/c{rng.randrange(30)}": str(rng.randrange(5)) for _ in range(200)} | {"top": "1", "dir": "1"}
    new = dict(old)
    for p in rng.sample(sorted(old), 5):
        new[p] = "changed"
    for p in rng.sample(sorted(old), 4):
        new.pop(p)
    new.pop("dir", None)
    new |= {"dir/file": "1", "a0/new/deep/er": "1"}
    frames = [spark.createDataFrame(sorted(x.items()), "path string, content_hash string") for x in (old, new)]
    found, compared = tree_changes(*map(with_directories, frames))
    wanted = {tuple(r) for r in change_set(*frames).collect()}
    assert {tuple(r) for r in found.collect()} == wanted
    above = {"/".join(p.split("/")[:n]) for p, _ in wanted for n in range(1, p.count("/") + 1)}
    assert {r["path"] for r in compared.collect()} == above

