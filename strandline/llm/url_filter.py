"""Temporal list join: URL captures against the block-list entries in force when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty where the URL has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to): an `add` holds from its day until the day of the entry after it.

    Of several entries for one pattern on one day, `remove` wins. A pattern has at most one row a day, so
    its history is bounded by the calendar whatever the number of entries.
    """
    keys = ["list", "kind", "pattern"]
    days = entries.where(F.col("effective_on").isNotNull() & F.col("action").isin("add", "remove") & (F.length("pattern") > 0))
    days = days.groupBy(*keys, "effective_on").agg(F.max("action").alias("action"))
    following = F.lead("effective_on").over(Window.partitionBy(*keys).orderBy("effective_on"))
    spans = days.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("date")))
    return spans.where(F.col("action") == "add").select(*keys, F.col("effective_on").alias("valid_from"), "valid_to")


def _keys(host: Column, path: Column, depth: int) -> Column:
    """Everything an entry may name to mean this URL: the host, the host and each domain above it, the host alone and with each path prefix."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.least(F.size(steps), F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws("/", F.array(host), F.slice(steps, F.lit(1), i)))

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))

    return F.when(host != "", F.concat(named("host", F.array(host)), named("domain", domains), named("prefix", prefixes)))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched_on): these, blocked, n_entries, first_entry.

    entries: list, kind (`host`: that host; `domain`: the host or any below it, of one label too; `prefix`:
    host and leading path segments, as `host/a/b`), pattern, action (`add`, `remove`), effective_on. Hosts,
    paths and patterns compare in lower case; empty path segments and slashes at the end of a pattern say nothing. An entry counts where
    it holds on the day of the capture: from its own day on, before the day of its successor. first_entry
    is the least `list|kind|pattern` that counts. Null or hostless URLs and null days are not blocked.
    Repeated captures repeat; an empty list blocks nothing; extra columns are not read.

    Equal captures are judged once. Each entry's interval is laid out by the years it covers, so a capture
    meets only the intervals of its own key and year; which side is broadcast follows the measured sizes.
    """
    tidy = F.rtrim(F.regexp_replace(F.lower("pattern"), "//+", "/"), F.lit("/"))
    spans = validity(entries.select("list", F.lower("kind").alias("kind"), tidy.alias("pattern"), "action", "effective_on"))
    deepest = spans.where(F.col("kind") == "prefix").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    days = captures.agg(F.min("fetched_on"), F.max("fetched_on")).first()
    first, last = (F.lit(d).cast("date") for d in (days[0], days[1]))
    # only years with captures: a span without end is no endless row
    spans = spans.where((F.col("valid_from") <= last) & (F.col("valid_to") > first))
    spans = spans.withColumn("year", F.explode(F.sequence(F.year(F.greatest("valid_from", first)), F.year(F.least("valid_to", last)))))
    distinct = captures.where(F.col("url").isNotNull() & F.col("fetched_on").isNotNull()).select("url", "fetched_on").distinct()
    keyed = distinct.select("url", "fetched_on", F.year("fetched_on").alias("year"), F.explode(_keys(host_of(F.col("url")), F.lower(path_of(F.col("url"))), deepest)).alias("key"))
    keyed = keyed.select("url", "fetched_on", "year", "key.kind", "key.pattern")
    hits = keyed.join(spans, ["kind", "pattern", "year"]).where((F.col("fetched_on") >= F.col("valid_from")) & (F.col("fetched_on") < F.col("valid_to")))
    told = hits.groupBy("url", "fetched_on").agg(F.count("*").alias("n_entries"), F.min(F.concat_ws("|", "list", "kind", "pattern")).alias("first_entry"))
    rows = captures.select("page_id", "url", "fetched_on").join(told, ["url", "fetched_on"], "left")
    return rows.select("page_id", "url", "fetched_on", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "first_entry")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures: the tables carry no fetch day, so it follows from the page's id, within three years."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2023-01-01', cast(pmod(page_id * 37, 1096) as int))").alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts by fixed rules, since the tables carry none.

    Of each host the first 32 bits of its name's MD5 decide: those that 3 divides enter as hosts, are removed after 90
    days and enter again after 400; parent domains of those that 5 divides enter for good; the language
    sections of those that 4 divides enter as path prefixes and are removed after 200 days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.element_at(F.split(F.lower(path_of(F.col("url"))), "/"), 2).alias("section"))
    hosts = hosts.where("host <> ''").distinct().withColumn("c", F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")).withColumn("d", F.expr("date_add(DATE'2023-01-01', cast(c % 700 as int))"))
    named = hosts.select("host", "c", "d").distinct()

    def rows(source: DataFrame, where: str, kind: str, pattern: str, action: str, after: int) -> DataFrame:
        return source.where(where).select(F.lit("rules").alias("list"), F.lit(kind).alias("kind"), F.expr(pattern).alias("pattern"), F.lit(action).alias("action"), F.date_add("d", after).alias("effective_on"))

    parent = "regexp_replace(host, '^[^.]*[.]', '')"
    parts = [
        rows(named, "c % 3 = 0", "host", "host", "add", 0),
        rows(named, "c % 3 = 0", "host", "host", "remove", 90),
        rows(named, "c % 3 = 0", "host", "host", "add", 400),
        rows(named, f"c % 5 = 0 and {parent} like '%.%.%'", "domain", parent, "add", 30),
        rows(hosts, "c % 4 = 0 and section is not null and section <> ''", "prefix", "concat(host, '/', section)", "add", 10),
        rows(hosts, "c % 4 = 0 and section is not null and section <> ''", "prefix", "concat(host, '/', section)", "remove", 210),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
