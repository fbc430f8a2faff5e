import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text) pairs."""

    def documents(texts, **more):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCUMENTS)

    return documents


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, a very long text, and columns named as an operator's own might be."""
    rows = [
        (None, "a null id", 1), (1, None, 2), (2, "", 3), (3, "   ", 4), (4, "same words here and there again", 5), (4, "same words here and there again", 5),
        (5, "same words here and there again", 6), (6, "x" * 200_000, 7), (7, "word " * 20_000, 8), (8, "\x00 nul and 😀 \ud83d".encode("utf-8", "replace").decode(), 9), (9, None, None),
    ]
    clash = "h string, maybe string, row string, block long, words string, node long, label long, bucket long, score string, lang_pred string, c0 string, t string, rank long, group string, shard long"
    columns = [c.split()[0] for c in clash.split(", ")]
    more = tuple(f"{c}" if "string" in d else 1 for c, d in zip(columns, clash.split(", "), strict=True))
    return spark.createDataFrame([(i, t, None if n is None else "en", "s", n, *more) for i, t, n in rows], f"{DOCUMENTS}, {clash}")


@pytest.fixture(scope="session")
def sf(spark):
    folder = "/root/testdata/sf0.001"
    return folder, lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n: [rng.choice(vocabulary) for _ in range(n)]
