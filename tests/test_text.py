import fnmatch
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions.ignore import compile_rule, ignored, internal, parse_rules
from strandline.functions.predicates import where
from strandline.functions.text import cosine, estimated_tokens, hash_embedding, normalize, py_strip
from strandline.model import StrandlineError
from strandline.operators.chunk import HeadingChunker, WholeFileChunker, WindowChunker, line_windows

EDGES = ["", " ", "\n", "a\r\nb\rc", "x \t \n y  ", "\x1c a \x85", "---\nk: v\n---\nbody", "---\nk\n----x", "a  \t b", "emoji 😀 　", "​ zero", "end \n \n"]


def test_strip_and_normalize_are_those_of_python(spark):
    rows = spark.createDataFrame([(t,) for t in EDGES], "t string")
    col = F.col("t")
    found = rows.select(col, py_strip(col).alias("s"), normalize(col).alias("n"), normalize(col, {"strip_frontmatter": True, "collapse_whitespace": True}).alias("a")).collect()
    for r in found:
        assert r["s"] == r["t"].strip()
        ends = r["t"].replace("\r\n", "\n").replace("\r", "\n")
        assert r["n"] == "\n".join(x.rstrip() for x in ends.split("\n"))
        front = re.sub(r"\A---\n.*?\n---\n?", "", ends, count=1, flags=re.S)
        assert r["a"] == re.sub(r"[ \t]+", " ", "\n".join(x.rstrip() for x in front.split("\n")))


def test_vectors_and_tokens(spark):
    row = spark.createDataFrame([("abc", [1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0])], "t string, a array<double>, b array<double>, z array<double>, s array<double>")
    got = row.select(hash_embedding(F.col("t")), cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("s")), estimated_tokens(F.col("t")), estimated_tokens(F.lit(""))).first()
    assert list(got[0]) == [b / 255 for b in hashlib.sha256(b"abc").digest()]
    assert (got[1], got[2], got[3], got[4], got[5]) == (1.0, 0.0, 0.0, 1, 0)


def test_filters(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    assert [r["k"] for r in rows.where(where("v == 'x'", rows.columns)).collect()] == ["a"]
    assert [r["k"] for r in rows.where(where("v == ''", rows.columns)).collect()] == ["b"]
    assert rows.where(where("v != 'x' AND nothing == ''", rows.columns)).count() == 1
    with pytest.raises(StrandlineError):
        where("v > 3", rows.columns)
    assert rows.where(where("v > 3", rows.columns, strict=False)).count() == 2


def test_ignore_rules(spark):
    paths = [".env", "a/.env", "dist", "dist/x", "a/dist/y", "src/a/b.py", "src/b.py", "keep/dist/z", "x.tmp", "a[1].txt", ".git/x", "./.strandline/y", ".strandlineignore", ".gitx"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")

    def hit(text, strict=False):
        return {r["path"] for r in rows.where(ignored(F.col("path"), parse_rules(text), strict)).collect()}

    assert hit(".env") == {"a/.env"} and hit(".env", strict=True) == {".env", "a/.env"}
    assert hit("dist/") == {"dist", "dist/x", "a/dist/y", "keep/dist/z"}
    assert hit("dist/\n!keep/dist/z") == {"dist", "dist/x", "a/dist/y"}
    assert hit("/dist") == {"dist", "dist/x"}
    assert hit("src/**/*.py") == {"src/a/b.py", "src/b.py"} and hit("src/*.py") == {"src/b.py"}
    assert hit("?.tmp\n# comment\n\n") == {"x.tmp"} and hit("a[1].txt") == {"a[1].txt"}
    own = {r["path"] for r in rows.where(internal(F.col("path"))).collect()}
    assert own == {".git/x", "./.strandline/y", ".strandlineignore"}


@given(st.text("ab/*?.", max_size=8), st.text("ab/.", max_size=8))
def test_plain_globs_agree_with_fnmatch(pattern, name):
    if "/" in pattern or "/" in name or "**" in pattern or not pattern or pattern.startswith("!"):
        return
    assert bool(re.match(compile_rule(pattern).regex, name)) == fnmatch.fnmatchcase(name, pattern)


def windows_by_hand(lines, largest, overlap):
    """The rules of the windows, line by line."""
    out, start = [], 0
    while start < len(lines):
        end = start + 1
        while end < len(lines) and len("\n".join(lines[start : end + 1])) <= largest:
            end += 1
        out.append((start, end))
        nxt = end
        while nxt - 1 > start and sum(len(x) + 1 for x in lines[nxt - 1 : end]) <= overlap:
            nxt -= 1
        start = nxt
    return out


@settings(max_examples=400)
@given(st.lists(st.text("ab ", max_size=12), max_size=30), st.integers(1, 40), st.integers(0, 30))
def test_windows(lines, largest, overlap):
    assert list(line_windows(lines, largest, overlap)) == windows_by_hand(lines, largest, overlap)


def test_cascade_of_short_tail_windows():
    found = list(line_windows(["x" * 20] * 100, 1000, 100))
    assert found == [(0, 47), (43, 90), (86, 100), (96, 100), (97, 100), (98, 100), (99, 100)]


def test_headings():
    def shapes(text, **options):
        return [(c.chunk_type, c.text, c.heading_path) for c in HeadingChunker(**options).chunk(text, "p")]

    assert shapes("before\n# A\nx\n## B\n#### not one\n### C\n# D") == [
        ("parent", "# A", "A"), ("child", "x", "A"), ("parent", "## B", "A > B"), ("child", "#### not one", "A > B"), ("parent", "### C", "A > B > C"), ("parent", "# D", "D"),
    ]
    assert shapes("### deep\n## under") == [("parent", "### deep", "deep"), ("parent", "## under", "deep > under")]
    assert shapes(" \n") == [] and shapes(" text ") == [("parent", "text", "")]
    assert [c[1] for c in shapes("# A\n\n" + "\n".join(["y" * 30] * 3) + "\n\n", max_chunk_size=65, overlap=0)] == ["# A", "y" * 30 + "\n" + "y" * 30, "y" * 30]
    assert [c.chunk_type for c in WindowChunker(10, 0).chunk("aaaaaaaa\nbbbbbbbb\ncccc", "p")] == ["parent", "child", "child"]
    assert WholeFileChunker().chunk("  ", "p") == []
