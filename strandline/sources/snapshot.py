"""Snapshots: (path, content_hash) and text of every file of a commit, from git or from a DataFrame."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.model import GitError
from strandline.sources.scratch import scratch_folder


def listing(files: DataFrame) -> DataFrame:
    """Paths of a snapshot in order."""
    return files.select("path").distinct().orderBy("path")


@dataclass(frozen=True)
class GitSource:
    """A git repository. Directories are listed and compared, and files read, by the tasks."""

    root: Path

    @classmethod
    def discover(cls, path: str | Path = ".") -> GitSource:
        """The repository that holds the path."""
        done = subprocess.run(["git", "-C", str(path), "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=False)
        if done.returncode:
            raise GitError(f"not a git repository: {path}")
        return cls(Path(done.stdout.rstrip("\n")))

    def _git(self, *args: str) -> bytes:
        done = subprocess.run(["git", "-C", str(self.root), *args], capture_output=True, check=False)
        if done.returncode:
            raise GitError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
        return done.stdout

    def commit(self, ref: str) -> str:
        try:
            return self._git("rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()
        except GitError as error:
            raise GitError(f"unknown ref {ref!r}: {error}") from None

    def exists(self, commit: str) -> bool:
        return subprocess.run(["git", "-C", str(self.root), "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True, check=False).returncode == 0

    def repo_id(self) -> str:
        """The last root commit of the history."""
        return self._git("rev-list", "--max-parents=0", "HEAD").decode().split()[-1]

    def ahead(self, since: str, until: str) -> int:
        """Commits that `until` has and `since` has not; 0 where git cannot tell."""
        try:
            return int(self._git("rev-list", "--count", f"{since}..{until}"))
        except GitError:
            return 0

    def tree(self, spark: SparkSession, commit: str) -> DataFrame:
        """(path, content_hash) of the files of a commit; submodules hold no text and are left out."""
        return self.changes(spark, None, commit)[0].select("path", "content_hash")

    def changes(self, spark: SparkSession, since: str | None, until: str) -> tuple[DataFrame, DataFrame]:
        """(path, status, content_hash) of the files that two commits do not share, all of the second without a first; and (path) of the directories compared.

        Directories are compared level by level in the tasks: two with one id hold the same and are not opened, so k
        changed files open k times their depth at most. The driver sees the ids of the roots alone. The
        repository must lie where the executors can read it.
        """
        root, folder, level = str(self.root), scratch_folder(spark), 0
        ids = [self._git("rev-parse", f"{c}^{{tree}}").decode().strip() if c else "" for c in (since, until)]
        front = spark.createDataFrame([("", *ids)], "path string, old string, new string").where("old <> new")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
                for batch in batches:
                    rows = [r for d in batch.to_pylist() for r in _compared(d["path"], _entries(git, d["old"]), _entries(git, d["new"]))]
                    columns = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "path", "old", "new"])
                git.stdin.close()

        schema = "kind string, path string, old string, new string"
        while True:
            front.repartition("path").mapInArrow(run, schema).write.parquet(f"{folder}/{level}")
            found = spark.read.schema(schema).parquet(f"{folder}/{level}")
            front, level = found.where("kind = 'tree'").select("path", "old", "new"), level + 1
            if front.isEmpty():
                break
        every = spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in range(level)])
        status = F.when(F.col("old") == "", "A").when(F.col("new") == "", "D").otherwise("M")
        return every.where("kind = 'blob'").select("path", status.alias("status"), F.col("new").alias("content_hash")), every.where("kind = 'tree'").select("path")

    def texts(self, files: DataFrame) -> DataFrame:
        """(path, text) for rows (path, content_hash): each task reads its blobs through one git process.

        The repository must lie where the executors can read it.
        """
        root = str(self.root)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
                for batch in batches:
                    texts = []
                    for blob in batch["content_hash"].to_pylist():
                        git.stdin.write(f"{blob}\n".encode())
                        git.stdin.flush()
                        head = git.stdout.readline().split()
                        if len(head) < 3:
                            raise GitError(f"blob {blob} is missing")
                        texts.append(git.stdout.read(int(head[2])).decode("utf-8", "replace"))
                        git.stdout.read(1)
                    yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], names=["path", "text"])
                git.stdin.close()

        return files.select("path", "content_hash").mapInArrow(run, "path string, text string")

    def file_text(self, commit: str, path: str) -> str | None:
        """The text of one file of a commit; None if it has none."""
        done = subprocess.run(["git", "-C", str(self.root), "show", f"{commit}:{path}"], capture_output=True, check=False)
        return None if done.returncode else done.stdout.decode("utf-8", "replace")


def _entries(git: subprocess.Popen, tree: str) -> dict[bytes, tuple[str, str]]:
    """Kind and id of what stands in a tree, by name; nothing in none."""
    if not tree:
        return {}
    git.stdin.write(f"{tree}\n".encode())
    git.stdin.flush()
    head = git.stdout.readline().split()
    if len(head) < 3:
        raise GitError(f"tree {tree} is missing")
    data, size, at, out = git.stdout.read(int(head[2])), len(tree) // 2, 0, {}
    git.stdout.read(1)
    while at < len(data):
        blank, end = data.index(b" ", at), data.index(b"\0", at)
        mode, name, at = data[at:blank], data[blank + 1 : end], end + 1 + size
        kind = "tree" if mode in (b"40000", b"040000") else "commit" if mode == b"160000" else "blob"
        out[name] = kind, data[end + 1 : at].hex()
    return out


def _compared(path: str, old: dict[bytes, tuple[str, str]], new: dict[bytes, tuple[str, str]]) -> Iterator[tuple[str, str, str, str]]:
    """(kind, path, old id, new id) of the files and directories in which two directories differ; an id is empty on the side that lacks it."""
    for name in old.keys() | new.keys():
        before, after = old.get(name, ("", "")), new.get(name, ("", ""))
        shown = name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")
        for kind in ("blob", "tree"):
            ids = [x[1] if x[0] == kind else "" for x in (before, after)]
            if ids[0] != ids[1]:
                yield kind, f"{path}/{shown}" if path else shown, *ids
