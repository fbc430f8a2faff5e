"""Filters as Columns: those of the engine itself, and the short form that callers may write."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.model import StrandlineError


def of_ref(repo_id: str, ref: str) -> Column:
    return (F.col("repo_id") == F.lit(repo_id)) & (F.col("ref") == F.lit(ref))


def of_path(repo_id: str, ref: str, path: str) -> Column:
    return of_ref(repo_id, ref) & (F.col("path") == F.lit(path))


def stale_of_path(repo_id: str, ref: str, path: str, token: str) -> Column:
    return of_path(repo_id, ref, path) & (F.coalesce("seen_token", F.lit("")) != F.lit(token))


def where(expression: str | None, columns: Iterable[str], strict: bool = True) -> Column:
    """Clauses `name == 'value'` or `name != 'value'`, joined by ` AND `.

    Values compare as strings; a null or unknown field is the empty string. Anything else is an error,
    or, where not `strict`, a clause that is always true.
    """
    known = set(columns)
    clauses: list[Column] = []
    for clause in (expression or "").split(" AND ") if (expression or "").strip() else []:
        sign = "!=" if "!=" in clause else "==" if "==" in clause else None
        if sign is None:
            if strict:
                raise StrandlineError(f"unsupported filter clause: {clause.strip()!r}")
            continue
        name, value = (part.strip().strip("'\"") for part in clause.split(sign, 1))
        field = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in known else F.lit("")
        clauses.append(field == F.lit(value) if sign == "==" else field != F.lit(value))
    return reduce(Column.__and__, clauses, F.lit(True))


def facts(expression: str | None) -> dict[str, str]:
    """The values that the clauses `name == 'value'` of such an expression ask for; of two for one name the last."""
    found = {}
    for clause in (expression or "").split(" AND "):
        if "==" in clause and "!=" not in clause:
            name, value = (part.strip().strip("'\"") for part in clause.split("==", 1))
            found[name] = value
    return found
