"""Hard negatives, alignment of tokenizers and license scans, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from pyspark.sql import functions as F

from strandline.llm import alignment, hard_negatives, license_scan
from strandline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"

# Hard negatives


def test_hard_negatives_equal_their_sql(spark):
    same(spark, SF, QUERIES["op11_hard_negatives"], ORACLES["op11_hard_negatives"])


def mined_by_force(rows, is_anchor):
    """Rows that are alike count once, as the operator has it."""
    rows = sorted({(i, lab, tuple(float(np.floor(256 * x)) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = set()
    for i, lab, v in rows:
        if not is_anchor(i):
            continue
        scored = [(-int(sum(a * b for a, b in zip(v, w, strict=True))), j, other) for j, other, w in rows if len(w) == len(v)]
        positives = sorted({(s, j) for s, j, other in scored if other == lab and j != i})[:5]
        for s, j in positives:
            found = sorted({(t, n) for t, n, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s})[:10]
            out |= {(i, j, r, n, -s, -t) for r, (t, n) in enumerate(found, 1)}
    return out


def mined(frame, is_anchor, **more):
    found = hard_negatives.mine_hard_negatives(frame, is_anchor, **more)
    return {tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def test_hard_negatives_of_ties_odd_rows_and_many_blocks(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += rows[:7] + [(i, 1, [1.0, 1.0, 0.5, 0.25]) for i in range(1000, 1060)] + [(i, 2, [0.5, 0.5, 0.25, 0.0]) for i in range(2000, 2060)]
    rows += [(3000, None, [1.0] * 4), (3001, 1, None), (3002, 1, [1.0, None, 1.0, 1.0]), (3003, 1, [float("nan")] * 4), (3010, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4)]
    rows += [(10, 2, [0.25] * 4), (3020, 0, [1.0, 2.0]), (3021, 0, [1.0, 1.0]), (3022, 1, [0.5, 0.5]), (3030, 0, []), (3031, 0, []), (3032, 1, []), (3040, 0, [-1.0] * 4)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, codes string, anchor int").repartition(5)
    wanted = mined_by_force(rows, lambda i: i % 10 == 0)
    assert wanted and mined(frame, F.col("vec_id") % 10 == 0) == wanted
    assert mined(frame, F.col("vec_id") % 10 == 0, block_anchors=7, sample=20) == wanted
    assert mined(frame.limit(0), F.col("vec_id") % 10 == 0) == set()


def test_huge_components_are_exact(spark):
    rows = [(i, i % 2, [1e6 + i, float(i)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(frame, F.col("vec_id") % 5 == 0) == mined_by_force(rows, lambda i: i % 5 == 0)


def test_residual_norms_bound_every_score():
    rng = np.random.default_rng(2)
    x = hard_negatives.whole_components(rng.normal(size=(700, 10)))
    books = hard_negatives.codebooks(x[:300])
    codes, left = hard_negatives.quantised(x, books)
    anchors = hard_negatives._Anchors(np.arange(40), np.arange(40), np.zeros(40), x[:40], books)
    middle, error = anchors.bounds(codes, left)
    assert (np.abs(x @ x[:40].T - middle) <= error).all() and error.mean() < 0.5 * np.abs(middle).mean() + np.abs(x @ x[:40].T).std()


# Alignment


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*alignment.tokenizer_paths())


ODD = [
    "", None, "   ", " a", "a ", "a  b", "a \n b\n\n c", "a\xa0 b  c\xa0", "x▁y the", "\x1c  a \x1c b", "tab\t\tx \t y", "　 a  b　", "é" * 50, "<s> </s> <|endoftext|> <unk>", "\r\n a\r\n",
    "🙂🙂 👩‍👩‍👧 x", "a᠎  b", "a​  b", "don't  I'LL 's", " \n", "\n", "   x y   z", "a" * 3000, " \t \n  z ! \x85  q", "the ▁ the", "the cat", "the cat",
]


def odd_texts(n=250):
    rng = random.Random(4)
    signs = [" ", " ", "\n", "\t", "a", "b", "the", "1", "!", "\xa0", "　", "\x85", "\x1d", "é", " ", "'s", "🙂", "​", "᠎", "﻿"]
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def aligned_by_force(rows, both):
    told, count = [], Counter()
    for doc, text in rows:
        a = both.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        data = f" {text}".encode()
        if b"".join(both.bytes_a[i] for i in a) != data or b"".join(both.bytes_b[i] for i in b) != data:
            a, b = [], []
        ends_a, ends_b = np.cumsum([0, *(len(both.bytes_a[i]) for i in a)]).tolist(), np.cumsum([0, *(len(both.bytes_b[i]) for i in b)]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b))[1:]:
            groups.append(",".join(str(a[k]) for k in range(i, ends_a.index(cut))) + "|" + ",".join(str(b[k]) for k in range(j, ends_b.index(cut))))
            i, j = ends_a.index(cut), ends_b.index(cut)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ends_a[i] < ends_b[j + 1] and ends_b[j] < ends_a[i + 1]]
        count.update(links)
        told.append((doc, a, b, groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((d, len(a), len(b), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, links in told)


def digest(frame, **more):
    return sorted(tuple(r) for r in alignment.alignment_digest(alignment.align_documents(frame, **more)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_texts_are_cut_without_a_search_as_the_rule_cuts_them():
    rng = random.Random(2)
    signs = ["a", "b", "\u00e9", "\u65e5", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\xa0", "\u200b", "\0", "\u3000", "\x85"]
    for cut in (" \n\t\r", " \n\t", " "):
        for n in range(4_000):
            text = "".join(rng.choices(signs if n % 2 else signs[:8], k=rng.randrange(1, 12)))
            assert alignment.segments_of(text, cut) == alignment._segments_by_rule(text, cut)


def test_groups_are_told_once_for_a_segment(both, monkeypatch):
    texts = ["one two", "two\nthree one", ""]
    segments = list(dict.fromkeys(s for t in texts if t for s in alignment.segments_of(t, both.cut)))
    codes, _ = zip(*both.align(segments), strict=True)
    written_as = [str(i) for i in range(60_000)]
    told = [alignment.groups_of(c, written_as) for c in codes]
    n = len(segments)
    columns = {"block": [5] * n, "first": [1] * n, "place": range(n), "code": [alignment._told(c, written_as) for c in codes], "n_best": [1] * n, "count_sum": [10] * n}
    # a block's documents are put together without telling anything again
    monkeypatch.setattr(alignment, "groups_of", None)
    batches = list(alignment._packed(iter(pa.RecordBatch.from_pydict(columns).slice(at, 2) for at in range(0, n, 2))))
    docs = pa.table({"doc_id": [7, 8, 9], "text": texts, "block": [5] * 3, "pos": pa.array([1, 2, 3], pa.int32())})
    rows = {r["doc_id"]: r for r in alignment._composed(both.cut)(docs, pa.Table.from_batches(batches)).to_pylist()}
    for doc, text in zip((7, 8, 9), texts, strict=True):
        own = [told[segments.index(s)] for s in alignment.segments_of(text, both.cut)] if text else []
        assert rows[doc]["groups"] == ";".join(t[4] for t in own)
        assert [rows[doc][c] for c in ("n_a", "n_b", "n_groups", "n_links")] == [sum(t[k] for t in own) for k in range(4)]
        assert (rows[doc]["n_best"], rows[doc]["count_sum"]) == (len(own), 10 * len(own))


def test_alignment_equals_brute_force(spark, both):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    extra = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 600").select("doc_id", "text").limit(40).collect()]
    rows += [(10_000 + r[0], r[1]) for r in extra]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, pos int").repartition(3)
    wanted = aligned_by_force(rows, both)
    assert digest(frame) == wanted
    assert digest(frame, block_chars=2_000, part_pairs=300) == wanted  # many blocks, and pairs in many parts
    assert digest(frame.limit(0)) == []


def test_segments_give_back_texts_and_their_tokens(both):
    assert set(both.cut) >= {" ", "\n"}
    for text in odd_texts(400):
        if text and "▁" not in text:
            parts = alignment.segments_of(text, both.cut)
            assert "".join(parts) == f" {text}"
            ids = [i for p in parts for i in both.a.encode(p, add_special_tokens=False).ids]
            assert ids == both.a.encode(f" {text}", add_special_tokens=False).ids


def test_groups_with_many_tokens_are_coded_in_four_bytes():
    a, b = list(range(70_000)), [5]
    code, links = alignment._aligned(a, b, [1] * 70_000, [70_000], "I")
    n_a, n_b, n_groups, n_links, text = alignment.groups_of(code, [str(i) for i in range(70_000)])
    assert (n_a, n_b, n_groups, n_links) == (70_000, 1, 1, 70_000) and text.endswith("69999|5") and len(links) == 8 * 70_000


# License scans


def scanned_by_force(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


LICENSED = [
    None, "", "mit", "Under the MIT license under the mit LICENSE", "cc-by-nc cc by nc cc_by_nc 4", "apache license version 2.0 apache license, version 20", "İ under the mit license",
    "Kapache license version 2", "under the mit licensK", "x" * 50_000, "cc by nc " * 2_000, "a\x00under\x00the\x00mit\x00license", "é under the mit license é", "cc by cc by nc by nc",
]


def test_phrases_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(LICENSED)] + [(3, LICENSED[3]), (None, "cc by nc"), (None, None)]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").collect()]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, maybe int").repartition(4)
    found = license_scan.license_digest(license_scan.scan_licenses(frame))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert got == sorted(((d, *scanned_by_force(t)) for d, t in rows), key=repr)
    assert found.where("score < 0 or score > 1 or (n_base > 0 and score < 1)").count() == 0
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_edited_notices_are_found_where_they_stand(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(n))
    long = [(label, n) for label, notices in license_scan.NOTICES.items() for n in notices if len(license_scan.words_of(n)) >= 12]
    rows, wanted = [], {}
    for i, (label, notice) in enumerate(long * 3):
        words = license_scan.words_of(notice)
        for _ in range(int(len(words) * 0.1) if i >= len(long) else 0):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = rng.choice([[], ["zzz"]])
        before = rng.randint(0, 200)
        rows.append((i, f"{filler(before)} {' '.join(words)} {filler(30)}"))
        wanted[i] = (label, before, len(words))
    rows.append((999, filler(3_000)))
    found = {r["doc_id"]: r["found"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[999] == []
    for i, (label, first, n) in wanted.items():
        assert any(f["label"] == label and abs(f["first"] - first) <= 3 and abs(f["last"] - (first + n - 1)) <= 3 and f["score"] >= 0.8 for f in found[i]), (label, found[i])


def test_places_equal_the_table_of_edit_distances():
    rng = random.Random(14)
    for _ in range(300):
        wanted, words = [rng.choice("abc") for _ in range(rng.randint(1, 6))], [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        row = [list(range(len(wanted) + 1))]
        for w in words:
            last, new = row[-1], [0]
            for i, x in enumerate(wanted, 1):
                new.append(min(last[i - 1] + (x != w), last[i] + 1, new[-1] + 1))
            row.append(new)
        assert license_scan._ends(wanted, words) == [r[-1] for r in row[1:]]
    assert license_scan.approximate_places(["a", "b", "c"], list("xxabcxxaxbcxabc"), 0) == [(2, 5, 0), (12, 15, 0)]
