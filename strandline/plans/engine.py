"""An index over a git repository: init, sync, query, status, check and verify."""

from __future__ import annotations

import shutil
import time
import uuid
import warnings
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.ignore import Rule, ignored, internal, parse_rules
from strandline.functions.predicates import facts, of_ref, where
from strandline.model import (
    DEFAULT_REF,
    IGNORE_FILE,
    STATE_DIR,
    CheckResult,
    EmbeddingError,
    InitResult,
    QueryResult,
    StatusResult,
    StrandlineError,
    SyncResult,
    SyncStats,
    VerifyResult,
    default_config,
)
from strandline.operators.chunk import Chunker, create_chunker, expected_rows
from strandline.operators.delta import planned
from strandline.operators.embed import Embedder, create_embedder, with_retry
from strandline.operators.reconcile import differences
from strandline.operators.search import results, top_k
from strandline.operators.vector_index import VectorIndex
from strandline.operators.verify import file_checks, ignored_stale, stale_deleted
from strandline.plans.refresh import Counts, refresh
from strandline.sources.snapshot import GitSource
from strandline.sources.state import read_config, read_json, single_writer, write_config, write_json
from strandline.sources.table import LOOKED_UP, IndexTable, create_store

# The state that must agree between syncs.
FINGERPRINT = ("chunk_schema_id", "embedder_id", "config_chunker_id", "config_embedder_id")

PAGE = 10_000  # files that a result names; their number is always told, and all of them lie beside the table


class Index:
    """Keeps the index of the repository that holds `path`; parts given here take the place of the configured ones."""

    def __init__(self, spark: SparkSession, path: str | Path = ".", chunker: Chunker | None = None, embedder: Embedder | None = None):
        self.spark, self._start, self._chunker, self._embedder = spark, Path(path), chunker, embedder

    @property
    def source(self) -> GitSource:
        return GitSource.discover(self._start)

    @property
    def state(self) -> Path:
        return self.source.root / STATE_DIR

    def config(self) -> dict[str, Any]:
        return read_config(self.state / "config.yaml")

    def table(self, config: dict[str, Any]) -> IndexTable:
        store = config.get("vectorstore") or {}
        path = str((config.get("collection") or {}).get("path") or f"{STATE_DIR}/index")
        if "://" not in path:
            path = (self.source.root / path).resolve().as_uri()
        return create_store(self.spark, str(store.get("id")), path, store.get("options"))

    def as_dataframe(self) -> DataFrame:
        """The index rows, for any query of Spark's own."""
        return self.table(self.config()).read()

    def _parts(self, config: dict[str, Any]) -> tuple[Chunker, Embedder, dict[str, str]]:
        chunker, embedder = self._chunker or create_chunker(config), self._embedder or create_embedder(config)
        print_ = (chunker.schema_id(), embedder.id(), str(config["chunker"]["id"]), str(config["embedder"]["id"]))
        return chunker, embedder, dict(zip(FINGERPRINT, print_, strict=True))

    @staticmethod
    def _differs(cursor: dict[str, Any] | None, fingerprint: dict[str, str]) -> list[str]:
        return [k for k, v in fingerprint.items() if (cursor or {}).get(k) and (cursor or {})[k] != v]

    def init(self, collection: str | None = None, embedder: str = "hash", chunker: str = "markdown-heading", force: bool = False) -> InitResult:
        """Writes the configuration; `force` deletes what an earlier one left."""
        source = self.source
        if (self.state / "config.yaml").exists() and not force:
            raise StrandlineError("already initialized; use force to begin anew")
        if force and self.state.exists():
            shutil.rmtree(self.state)
        config = default_config(source.repo_id(), collection, chunker, embedder)
        write_config(self.state / "config.yaml", config)
        return InitResult(config["repo_id"], config["collection"]["name"], chunker, embedder, config["vectorstore"]["id"], str(self.state))

    def _rules(self, commit: str | None) -> list[Rule]:
        return parse_rules(self.source.file_text(commit, IGNORE_FILE)) if commit else []

    def sync(
        self,
        ref: str | None = None,
        full: bool = False,
        dry_run: bool = False,
        batch_size: int | None = None,
        max_concurrent: int | None = None,
        max_retries: int | None = None,
        wait: bool = False,
    ) -> SyncResult:
        """Brings the index from the last synced commit to the head of the ref.

        A sync that was broken off is finished first, with its own commits and ref. Nothing of a sync is
        seen before all of it is.
        """
        began = time.perf_counter()
        config, source = self.config(), self.source
        chunker, embedder, fingerprint = self._parts(config)
        table = self.table(config)
        with single_writer(self.state / "lock", wait):
            cursor, txn = read_json(self.state / "cursor.json"), read_json(self.state / "txn.json")
            differs = self._differs(cursor, fingerprint)
            if differs and not full:
                raise StrandlineError(f"the index was made with other parts ({', '.join(differs)}); sync with full")
            ref = str((txn or {}).get("ref") or ref or (cursor or {}).get("ref") or config.get("ref") or DEFAULT_REF)
            since = txn["from_commit"] if txn else (cursor or {}).get("last_synced_commit")
            until = txn["to_commit"] if txn else source.commit(ref)
            token = txn["sync_token"] if txn else uuid.uuid4().hex
            repo_id = str(config["repo_id"])
            if since is not None and not source.exists(since):
                since = None
            if since == until and not txn and not full:
                return SyncResult(since, until, 0, already_up_to_date=True, stats=SyncStats(time.perf_counter() - began))
            known = None if full else since
            changes = source.changes(self.spark, known, until)[0]
            rules, before, new = self._rules(until), None, changes
            if known is not None and not changes.where(F.col("path") == IGNORE_FILE).isEmpty():
                before, new = self._rules(known), source.tree(self.spark, until)
            # the plan lies beside the table, whatever its length; the caller gets its size and its first paths
            todo = staged_at(planned(changes, new, rules, before), f"{table.path}/plans/{token}-{uuid.uuid4().hex[:8]}")
            number, paths = todo.count(), first_paths(todo)
            if dry_run:
                return SyncResult(since, until, 0, dry_run=True, planned_files=paths, files_planned=number, recovered=bool(txn), stats=SyncStats(time.perf_counter() - began))
            txn = {"from_commit": since, "to_commit": until, "sync_token": token, "repo_id": repo_id, "ref": ref, "started_at": (txn or {}).get("started_at") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            was_txn = read_json(self.state / "txn.json") is not None
            write_json(self.state / "txn.json", txn)
            counts = Counts()
            if number:
                options = config["embedder"]
                embedding = {"batch_size": batch_size or options.get("batch_size", 64), "max_concurrent": max_concurrent or options.get("max_concurrent", 1), "retries": options.get("max_retries", 3) if max_retries is None else max_retries}
                changed = new.join(todo.where(F.col("status") != "D").select("path"), "path", "left_semi")
                counts = refresh(table, todo, source.texts(changed), chunker, embedder, repo_id, ref, until, token, config.get("normalize"), embedding, full)
            if self._approximate(config):
                VectorIndex(self.spark, f"{table.path}/vectors").follow(table)
            write_json(self.state / "cursor.json", {"last_synced_commit": until, "ref": ref, "repo_id": repo_id, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **fingerprint})
            (self.state / "txn.json").unlink(missing_ok=True)
            stats = SyncStats(time.perf_counter() - began, counts.calls, counts.texts, counts.tokens)
            return SyncResult(since, until, number, paths, counts.added, counts.updated, counts.deleted, recovered=was_txn, stats=stats)

    def query_frame(self, vector: list[float], k: int = 10, ref: str | None = None, filter_expr: str | None = None, approximate: bool | None = None) -> DataFrame:
        """The answer as a DataFrame, best first. `approximate`, or the store's option of that name, lets the vector index choose the rows to compare."""
        config = self.config()
        ref = ref or (read_json(self.state / "cursor.json") or {}).get("ref") or config.get("ref") or DEFAULT_REF
        table, wanted = self.table(config), of_ref(str(config["repo_id"]), str(ref))
        approximate = self._approximate(config) if approximate is None else approximate
        codes = VectorIndex(self.spark, f"{table.path}/vectors") if approximate else None
        if codes is not None and k > 0 and codes.version == table.manifest()["version"]:
            # codes choose the rows, their exact vectors rank them; codes that are behind the table choose nothing
            near = codes.rows_near(table, vector, k, wanted & where(filter_expr, table.read([]).columns))
            if near is not None:
                return results(top_k(near, vector, k, wanted & where(filter_expr, near.columns)))
        asked = {f: v for f, v in facts(filter_expr).items() if f in LOOKED_UP}
        index = table.read(facts=asked | {"repo_id": str(config["repo_id"]), "ref": str(ref)})
        return results(top_k(index, vector, k, wanted & where(filter_expr, index.columns)))

    @staticmethod
    def _approximate(config: dict[str, Any]) -> bool:
        return bool(((config.get("vectorstore") or {}).get("options") or {}).get("approximate"))

    def query(self, text: str, k: int = 10, ref: str | None = None, filter_expr: str | None = None, approximate: bool | None = None) -> list[QueryResult]:
        """The k chunks nearest to the text; none, with a warning, where nothing is indexed."""
        if not text.strip():
            raise StrandlineError("the query text is empty")
        config = self.config()
        if k <= 0:
            return []
        table = self.table(config)
        if not (read_json(self.state / "cursor.json") or {}).get("last_synced_commit") or not table.count():
            warnings.warn("the index is empty: run sync first", RuntimeWarning, stacklevel=2)
            return []
        embedder = self._embedder or create_embedder(config)
        vector = with_retry(lambda: embedder.embed([text]), int(config["embedder"].get("max_retries", 3)))[0]
        rows = self.query_frame(vector, k, ref, filter_expr, approximate).orderBy(F.desc("score"), "doc_id").collect()
        return [QueryResult(**r.asDict()) for r in rows]

    def status(self) -> StatusResult:
        config, source = self.config(), self.source
        cursor, txn = read_json(self.state / "cursor.json") or {}, read_json(self.state / "txn.json")
        ref = str(cursor.get("ref") or config.get("ref") or DEFAULT_REF)
        head, last = source.commit(ref), cursor.get("last_synced_commit")
        state = "INTERRUPTED" if txn else "NOT_SYNCED" if not last else "UP_TO_DATE" if last == head else "OUT_OF_DATE"
        behind = source.ahead(last, head) if state == "OUT_OF_DATE" else 0
        return StatusResult(str(config["repo_id"]), ref, config["collection"]["name"], config["chunker"]["id"], config["embedder"]["id"], config["vectorstore"]["id"], last, head, state, behind, txn)

    def check(self) -> CheckResult:
        """Whether git, the embedder and the store answer."""
        config, errors = self.config(), []
        git: dict[str, Any] = {"repo_id": config["repo_id"], "ref": config["ref"]}
        try:
            git["head"] = self.source.commit(config["ref"])
        except StrandlineError as error:
            errors.append(str(error))
            git["error"] = str(error)
        about: dict[str, Any] = {"id": config["embedder"]["id"]}
        try:
            began = time.perf_counter()
            vectors = (self._embedder or create_embedder(config)).embed(["health check"])
            about |= {"dimension": len(vectors[0]), "latency_ms": int((time.perf_counter() - began) * 1000)}
            if not about["dimension"]:
                raise EmbeddingError("the embedder gives empty vectors")
        except Exception as error:  # whatever a provider raises is a failed check
            errors.append(f"embedder check failed: {error}")
            about["error"] = str(error)
        store: dict[str, Any] = {"id": config["vectorstore"]["id"]}
        try:
            store["doc_count"] = self.table(config).count()
        except Exception as error:
            errors.append(f"vector store check failed: {error}")
            store["error"] = str(error)
        oks = ["error" not in part for part in (git, about, store)]
        return CheckResult(*oks, errors, all(oks), git, about, store)

    def verify(self, ref: str | None = None, all: bool = False, fix: bool = False, sample: int | None = None) -> VerifyResult:
        """Compares the index with the files at the last synced commit; with `fix` mends it and compares again."""
        if fix:
            with single_writer(self.state / "lock"):
                mended = self._verify(ref, all, True, sample)
                again = self._verify(ref, all, False, sample)
            return VerifyResult(again.all_passed, again.basic_checks, again.file_checks, again.ignored_stale, mended.fixed)
        return self._verify(ref, all, False, sample)

    def _verify(self, ref: str | None, all_: bool, fix: bool, sample: int | None) -> VerifyResult:
        config, source = self.config(), self.source
        cursor, txn = read_json(self.state / "cursor.json") or {}, read_json(self.state / "txn.json")
        commit = cursor.get("last_synced_commit")
        if not commit:
            raise StrandlineError("never synced: run sync first")
        ref, repo_id = str(ref or cursor.get("ref") or config["ref"]), str(config["repo_id"])
        chunker, embedder, fingerprint = self._parts(config)
        table = self.table(config)
        basic = {"cursor_valid": True, "cursor_commit_exists": source.exists(commit), "no_pending_txn": txn is None, "schema_match": not self._differs(cursor, fingerprint), "collection_alive": True}
        try:
            index = table.read(facts={"repo_id": repo_id, "ref": ref}).where(of_ref(repo_id, ref)).select("path", "id")
        except Exception:  # a store that cannot be read is a finding
            basic["collection_alive"] = False
            return VerifyResult(False, basic)
        ignore_path = source.root / IGNORE_FILE
        left_out = ignored(F.col("path"), parse_rules(ignore_path.read_text("utf-8")) if ignore_path.exists() else [])
        tracked = source.tree(self.spark, commit) if basic["cursor_commit_exists"] else self.spark.createDataFrame([], "path string, content_hash string")
        tracked = tracked.where(~internal(F.col("path")) & ~left_out)
        checked = tracked if all_ else tracked.orderBy("path").limit(max(10 if sample is None else sample, 0))
        expected = expected_rows(source.texts(checked), chunker, config.get("normalize"), repo_id, ref, commit, "verify").select("path", "id")
        # the findings lie beside the table, one row a file; the caller gets those of the first files, failures before others
        folder = f"{table.path}/checks/{uuid.uuid4().hex}"
        if all_:
            # files are cut into chunks once; then sketches of both sides tell which rows differ
            differ = staged_at(differences(index, staged_at(expected, f"{folder}/expected")), f"{folder}/differences")
            found = file_checks(differ.where("have"), differ.where("want"), checked)
            gone = stale_deleted(differ.where("have"), tracked, left_out).select("path", F.lit(0).cast("long").alias("missing_count"), "stale_count", F.lit("FAIL").alias("status"), F.array(F.lit("STALE_DELETED")).alias("issues"))
            found = found.unionByName(gone, allowMissingColumns=True)
        else:
            found = file_checks(index, expected, checked)
        found, out = staged_at(found, f"{folder}/files"), staged_at(ignored_stale(index, left_out), f"{folder}/ignored")
        bad = found.where("status = 'FAIL'").select("path")
        n_bad, n_out = bad.count(), out.count()
        checks = []
        for r in found.orderBy(F.col("status") != "FAIL", "path").limit(PAGE).collect():
            row = {c: r[c] for c in ("path", "status", "issues", "missing_count", "stale_count")}
            checks.append(row | {c: r[c] for c in ("missing_ids", "stale_ids") if r[c]})
        checks.sort(key=lambda c: ("STALE_DELETED" in c["issues"], c["path"]))
        if fix and (n_bad or n_out):
            processed = bad.union(out).distinct()
            files = source.texts(tracked.join(processed, "path", "left_semi"))
            refresh(table, processed, files, chunker, embedder, repo_id, ref, commit, "verify-fix", config.get("normalize"), reembed=True)
        return VerifyResult(not n_bad and not n_out and all(basic.values()), basic, checks, first_paths(out), bool(fix and (n_bad or n_out)))


def staged_at(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written to `path` and read from there."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def first_paths(rows: DataFrame) -> list[str]:
    """The first `PAGE` paths in order."""
    return [r["path"] for r in rows.select("path").orderBy("path").limit(PAGE).collect()]
