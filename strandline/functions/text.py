"""Text and vector expressions, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Python's str.strip; trimming by characters is far cheaper than an unanchored pattern.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def py_strip(text: Column) -> Column:
    """Both ends without white space, as str.strip() does it."""
    return F.btrim(text, F.lit(SPACES))


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_frontmatter(text: Column) -> Column:
    """Without a block between `---` lines at the very beginning."""
    return F.when(F.startswith(text, F.lit("---\n")), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")).otherwise(text)


def strip_trailing_whitespace(text: Column) -> Column:
    """Every line without white space at its end; only line feeds end lines."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.rtrim(line, F.lit(SPACES))), "\n")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), r"  +", " ")


def normalize(text: Column, options: dict[str, bool] | None = None) -> Column:
    """The steps that `options` turn on, in fixed order; the first and third are on where nothing is said."""
    options = options or {}
    for name, step, on in (
        ("normalize_newlines", normalize_newlines, True),
        ("strip_frontmatter", strip_frontmatter, False),
        ("strip_trailing_whitespace", strip_trailing_whitespace, True),
        ("collapse_whitespace", collapse_whitespace, False),
    ):
        if options.get(name, on):
            text = step(text)
    return text


def none_if_blank(text: Column) -> Column:
    stripped = py_strip(text)
    return F.when(stripped != "", stripped)


def short_id(commit: Column) -> Column:
    """First eight characters, `?` for none."""
    return F.coalesce(F.substring(F.nullif(commit, F.lit("")), 1, 8), F.lit("?"))


def state_label(state: Column) -> Column:
    """UP_TO_DATE and its like as they are shown; others unchanged."""
    return F.when(state.isin("UP_TO_DATE", "OUT_OF_DATE", "NOT_SYNCED", "INTERRUPTED"), F.replace(state, F.lit("_"), F.lit(" "))).otherwise(state)


def model_name(embedder_id: Column) -> Column:
    """What follows the first colon of `provider:model`; empty without one."""
    return F.when(F.instr(embedder_id, ":") > 0, F.element_at(F.split(embedder_id, ":", 2), 2)).otherwise(F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(repo_id: Column, ref: Column, path: Column, schema_id: Column, chunk_type: Column, heading_path: Column, hash_: Column, dup_index: Column) -> Column:
    """Key of a chunk by its place and content, the parts joined by NUL."""
    parts = (repo_id, ref, path, schema_id, chunk_type, heading_path, hash_, dup_index.cast("string"))
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def hash_embedding(text: Column) -> Column:
    """Stand-in vector without a model: the 32 bytes of the SHA-256, each divided by 255."""
    def places(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0))

    # through an array of one, so that the digest is computed once and not for each place
    return F.element_at(F.transform(F.array(F.sha2(text, 256)), places), 1)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; none for an empty text."""
    bytes_ = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(bytes_ > 0, F.floor((bytes_ + 3) / 4)).otherwise(F.lit(0)).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for vectors of different lengths or without length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)
