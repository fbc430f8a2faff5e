import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.text import normalize
from strandline.operators.chunk import WindowChunker, chunk_files
from strandline.operators.long_files import chunk_lines, read_lines

COLUMNS = ("path", "pos", "chunk_type", "heading_path", "text", "dup_index")


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts():
    rng = random.Random(7)
    made = {"empty": "", "blank": " \n\t\n  ", "one": "  a  ", "short": "\n\n a\nb \n", "long-line": "x" * 900, "long-lines": "\n".join(["y" * 300] * 4), "same": "ha\n" * 400, "nulls\0": "\0\n" * 50, "marks": "  é\n" * 90 + "🙂" * 70 + "\n　"}
    for i in range(30):
        width = rng.choice([3, 30, 200])
        made[f"r{i}"] = "\n".join(" " * rng.randrange(3) + "ab é"[: rng.randrange(5)] * rng.randrange(width) for _ in range(rng.randrange(1, 120)))
    return made


@pytest.mark.parametrize(("largest", "overlap"), [(40, 10), (100, 0), (1, 0), (60, 59), (50, 80)])
def test_lines_in_blocks_give_the_windows_of_whole_texts(spark, largest, overlap):
    made = texts()
    rng = random.Random(largest)
    lines = []
    for path, text in made.items():
        part = 0
        for i, line in enumerate(text.split("\n")):
            part += rng.random() < 0.1
            lines.append((path, part, i, line or None, "clash"))
    rng.shuffle(lines)
    chunker = WindowChunker(largest, overlap)
    wanted = chunk_files(spark.createDataFrame(list(made.items()), "path string, text string"), chunker)
    got = chunk_lines(spark.createDataFrame(lines, "path string, part long, place long, text string, line string").repartition(5), chunker, block=128)
    assert rows(got) == rows(wanted)


def test_no_lines_no_chunks(spark):
    got = chunk_lines(spark.createDataFrame([], "path string, part long, place long, text string"), WindowChunker())
    assert got.columns == list(COLUMNS) and got.count() == 0


def test_one_file_of_many_splits(spark, tmp_path):
    rng = random.Random(3)
    words = ["a", "bé", "ccc", "dddd dd", ""]
    text = " \r\n" + "".join(" ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["\n", "\r\n", " \t\n"]) for _ in range(60_000))
    (tmp_path / "big.txt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        lines = read_lines(spark, str(tmp_path / "big.txt"))
        assert lines.rdd.getNumPartitions() > 8 and lines.select("part").distinct().count() > 8
        got = rows(chunk_lines(lines, WindowChunker(), block=100_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    path = got[0][0]
    whole = spark.createDataFrame([(path, text)], "path string, text string").select("path", normalize(F.col("text")).alias("text"))
    assert got == rows(chunk_files(whole, WindowChunker()))
