"""Small files that the driver keeps: configuration, cursor, transaction and lock."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import yaml

from strandline.model import LockError, StrandlineError


def read_json(path: Path) -> dict[str, Any] | None:
    """The object in the file; None if there is no file, or no object in it."""
    try:
        value = json.loads(path.read_text("utf-8"))
    except (FileNotFoundError, json.JSONDecodeError):
        return None
    return value if isinstance(value, dict) else None


def write_json(path: Path, value: dict[str, Any]) -> None:
    """Replaces the file at once and only when its new content is on disk."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(value, file, indent=2, sort_keys=True)
            file.flush()
            os.fsync(file.fileno())
        os.replace(name, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise


def read_config(path: Path) -> dict[str, Any]:
    try:
        value = yaml.safe_load(path.read_text("utf-8"))
    except FileNotFoundError:
        raise StrandlineError("not initialized: run init first") from None
    if not isinstance(value, dict):
        raise StrandlineError(f"{path} holds no mapping")
    return value


def write_config(path: Path, value: dict[str, Any]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(value, sort_keys=False), "utf-8")


@contextlib.contextmanager
def single_writer(path: Path, wait: bool = False, poll: float = 0.1) -> Iterator[None]:
    """Holds the lock file for one sync; the system frees it when the process ends, however it ends."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a+") as file:
        while True:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if not wait:
                    raise LockError("another sync is running") from None
                time.sleep(poll)
        try:
            file.truncate(0)
            file.write(str(os.getpid()))
            file.flush()
            yield
        finally:
            fcntl.flock(file, fcntl.LOCK_UN)
