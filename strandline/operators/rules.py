"""Many ignore rules at once: a join on parts of the paths in place of one test a rule."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.ignore import Rule, ignored, tested_path

MATCHES = "kind string, key string, ordinal int, negated boolean, regex string"
MANY = 300  # from here on rules are looked up
CHAINED = 200  # rules without a key that may be one expression each


def rule_key(rule: Rule) -> tuple[str, str, str | None] | None:
    """(kind, key, regex) under which the paths of a rule are found; without a regex the key says all.

    `prefix`: the path begins with these names; `name`: it has this name somewhere; `ending`: a name ends
    so, from a dot on. None: the rule begins with a wildcard and says nothing that could be looked up.
    """
    pattern, rooted = rule.pattern, rule.rooted
    while pattern.startswith("**/"):
        pattern, rooted = pattern.removeprefix("**/"), False
        if "/" in pattern:
            return None
    if "/" in pattern or rooted:
        names = pattern.split("/")
        plain = next((i for i, n in enumerate(names) if re.search(r"[*?]", n)), len(names))
        if plain == len(names):
            return "prefix", pattern, None
        return ("prefix", "/".join(names[:plain]), rule.regex) if plain else None
    if not re.search(r"[*?]", pattern):
        return "name", pattern, None
    ending = pattern.removeprefix("*")
    return ("ending", ending, None) if pattern.startswith("*.") and not re.search(r"[*?]", ending) else None


def with_verdict(rows: DataFrame, rules: list[Rule], strict: bool = False, column: str = "ignored") -> DataFrame:
    """The rows with the answer of `ignored` for their `path`, by a plan that does not grow with the rules.

    A path looks its prefixes, names and endings up among the rules, and the last rule that matches decides. Rules
    that begin with a wildcard other than `*.` are tested on every path. A null path has the verdict false.
    """
    spark = rows.sparkSession
    keyed, rest = [], []
    for ordinal, rule in enumerate(rules):
        if (found := rule_key(rule)) is None:
            rest.append((ordinal, rule.regex))
        else:
            keyed.append((*found[:2], ordinal, rule.negated, found[2]))
    paths = rows.select("path").where("path is not null").distinct().withColumn("tested", tested_path(F.col("path"), strict))
    names = F.split("tested", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.array_join(F.slice("names", 1, i), "/"))
    def endings(name: Column) -> Column:
        parts = F.split(name, r"\.", -1)
        later = F.slice(F.sequence(F.lit(1), F.size(parts)), 2, F.size(parts))
        return F.transform(later, lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))

    dots = F.flatten(F.transform("names", endings))
    lists = {"prefix": prefixes, "name": F.array_distinct("names"), "ending": F.array_distinct(dots)}
    paths = paths.withColumn("names", names)
    wanted = sorted({k[0] for k in keyed})
    last = F.struct("ordinal", "negated")
    hits = None
    if wanted:
        def of_kind(kind: str) -> Column:
            return F.transform(lists[kind], lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))

        looked = F.flatten(F.array(*[of_kind(kind) for kind in wanted]))
        asked = paths.select("path", "tested", F.explode(looked).alias("at")).select("path", "tested", "at.*")
        hits = asked.join(spark.createDataFrame(keyed, MATCHES), ["kind", "key"]).where("regex is null or tested rlike regex").select("path", last.alias("last"))
    if rest:
        negated = {o: rules[o].negated for o, _ in rest}
        if len(rest) <= CHAINED:
            found = F.coalesce(*[F.when(F.col("tested").rlike(regex), F.struct(F.lit(o).alias("ordinal"), F.lit(negated[o]).alias("negated"))) for o, regex in reversed(rest)])
        else:
            about = F.from_json(F.lit(_as_json(rest, negated)), "array<struct<ordinal int, negated boolean, regex string>>")
            found = F.array_max(F.transform(F.filter(about, lambda r: F.rlike(F.col("tested"), r["regex"])), lambda r: F.struct(r["ordinal"].alias("ordinal"), r["negated"].alias("negated"))))
        free = paths.select("path", found.alias("last")).where("last is not null")
        hits = free if hits is None else hits.unionByName(free)
    if hits is None:
        return rows.withColumn(column, F.lit(False))
    verdicts = hits.groupBy("path").agg((~F.max("last")["negated"]).alias("_verdict"))
    verdict = F.coalesce("_verdict", F.lit(False))
    return rows.join(verdicts, "path", "left").select(*[c for c in rows.columns if c != column], verdict.alias(column))


def not_ignored(rows: DataFrame, rules: list[Rule], unless: Column | None = None) -> DataFrame:
    """The rows whose path no rule leaves out, and those that `unless` says; many rules are looked up."""
    kept = F.lit(False) if unless is None else unless
    if len(rules) <= MANY:
        return rows.where(kept | ~ignored(F.col("path"), rules))
    return with_verdict(rows, rules, column="_ignored").where(kept | ~F.col("_ignored")).drop("_ignored")


def _as_json(rest: list[tuple[int, str]], negated: dict[int, bool]) -> str:
    return json.dumps([{"ordinal": o, "negated": negated[o], "regex": regex} for o, regex in rest])
