"""Cross-tokenizer alignment: distinct segments are tokenised and aligned once, documents are composed of them."""

from __future__ import annotations

import itertools
import os
import re
import struct
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import give_back, releasing, small_batches, written

BLOCK_CHARS = 12_000_000
PART_PAIRS = 2_000_000
PACKED_ROWS = 200_000
# White space before which texts are cut, where the vocabularies allow it.
CUT_BEFORE = " \n\t\r"
# White space and what Python or the tokenizers take for it; a sign that marks cuts in texts without it.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() or c in "\u180e\u200b")
PLAIN_BLANKS = "".join(c for c in BLANKS if c.isascii())
MARK = "\0"
# The numbers before the groups of a segment.
HEAD = "<3i"
HEAD_BYTES = struct.calcsize(HEAD)
# The signs that stand for the bytes 0 to 255 in byte-level vocabularies are these ranges, then the rest from U+0100 on.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

ALIGNED_COLUMNS = "block long, first int, place int, n long, code binary, links binary"
PACKED_COLUMNS = "block long, first int, places binary, numbers binary, length long, groups binary, best binary, sums binary"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
DOCUMENT_COLUMNS = f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, groups string"


def tokenizer_paths() -> tuple[str, str]:
    """Where the public vocabularies of the query lie: A is byte-level, B of pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers of a worker: ids of segments, the bytes of ids, and the white space before which no token spans."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        rest = iter(range(0x100, 0x200))
        byte_of = {chr(b if b in PLAIN_BYTES else next(rest)): b for b in range(256)}
        self.bytes_a: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.sizes_a = {i: len(t) for i, t in self.bytes_a.items()}
        self.sizes_b = [len(t) for t in self.bytes_b]
        # with a token for every byte and no normal form A gives back every text
        self.lossless = self.a.normalizer is None and {bytes([i]) for i in range(256)} <= set(self.bytes_a.values())
        self.ids = "H" if max(*self.bytes_a, len(pieces)) < 1 << 16 else "I"  # how links are written
        # A's own rule ends a token before white space; B's tokens end there if no piece goes on with it
        texts = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        words_alone = "ByteLevel" in type(self.a.pre_tokenizer).__name__
        inner = {c for t in texts for x, c in zip(t, t[1:], strict=False) if c in CUT_BEFORE and x != c}
        mixed = {c for t in texts for c in t if c in CUT_BEFORE[1:] and len(t) > 1}
        self.cut = "".join(c for c in CUT_BEFORE if words_alone and c not in inner and c not in mixed)

    def align(self, segments: list[str]) -> Iterator[tuple[bytes | None, bytes | None]]:
        """For each segment its groups and links as `_aligned` codes them; None where the tokens do not give back its bytes."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a blank before all texts: it stands for the one that a segment begins with, or else is taken off again
        ids_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        sizes_a, sizes_b, bytes_a, bytes_b = self.sizes_a, self.sizes_b, self.bytes_a, self.bytes_b
        for segment, a, b in zip(segments, ids_a, ids_b, strict=True):
            if segment[0] != " ":
                b = b[1:] if b[:1] == [self.blank] else b
            data = segment.encode()
            whole = b"".join([bytes_b[i] for i in b]) == data and (self.lossless or b"".join([bytes_a[i] for i in a]) == data)
            yield _aligned(a, b, [sizes_a[i] for i in a], [sizes_b[i] for i in b], self.ids) if whole else (None, None)


def _aligned(a: list[int], b: list[int], sizes_a: list[int], sizes_b: list[int], ids: str) -> tuple[bytes, bytes]:
    """Tokens of two lists over the same bytes, in groups that end where both have an end, and all pairs that overlap, the links.

    A group is coded as the numbers of its tokens of A and B and their ids, a link as its two ids. A code begins
    with the bytes of a number: two, or four where ids or numbers of tokens need them.
    """
    groups, links = array("H" if ids == "H" and max(len(a), len(b)) < 1 << 16 else "I"), array(ids)
    i = j = from_a = from_b = 0
    end_a, end_b = sizes_a[0], sizes_b[0]
    while True:
        links.append(a[i])
        links.append(b[j])
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.extend((i - from_a, j - from_b, *a[from_a:i], *b[from_b:j]))
            if i == len(a):
                return bytes([groups.itemsize]) + groups.tobytes(), links.tobytes()
            from_a, from_b = i, j
            end_a, end_b = end_a + sizes_a[i], end_b + sizes_b[j]
        elif end_a < end_b:
            i += 1
            end_a += sizes_a[i]
        else:
            j += 1
            end_b += sizes_b[j]


def groups_of(code: bytes | memoryview, written_as: list[str]) -> tuple[int, int, int, int, str]:
    """Numbers of tokens of A and B, groups and links, and the groups as `a1,a2|b1;a3|b2,b3`."""
    at, n_a, n_b, out = 0, 0, 0, []
    ids = memoryview(bytes(code[1:])).cast("H" if code[0] == 2 else "I").tolist()
    while at < len(ids):
        a, b = ids[at], ids[at + 1]
        middle, end = at + 2 + a, at + 2 + a + b
        out.append(",".join([written_as[i] for i in ids[at + 2 : middle]]) + "|" + ",".join([written_as[i] for i in ids[middle:end]]))
        n_a, n_b, at = n_a + a, n_b + b, end
    return n_a, n_b, len(out), n_a + n_b - len(out), ";".join(out)


def _told(code: bytes | None, written_as: list[str]) -> bytes | None:
    """The groups of a code as text behind the numbers of tokens of A and B and of groups: told once for a segment, whatever the number of blocks that hold it."""
    if code is None:
        return None
    n_a, n_b, n_groups, _, text = groups_of(code, written_as)
    return struct.pack(HEAD, n_a, n_b, n_groups) + text.encode()


def segments_of(text: str, cut: str = CUT_BEFORE) -> list[str]:
    """The text with a blank before it, cut before each run of white space that begins with one of `cut` behind another sign.

    A run at the end stays with the last segment. Runs that begin with other white space are not cut off.
    """
    if not cut:
        return [f" {text}"]
    if MARK in text or any(c in text for c in (PLAIN_BLANKS if text.isascii() else BLANKS) if c not in cut):
        return _segments_by_rule(text, cut)
    # a mark before each white space, then none between two: replacing and splitting take a tenth of a search for the runs
    found = [c for c in cut if c == " " or c in text]
    text = f" {text}"
    for c in found:
        text = text.replace(c, MARK + c)
    for c in found:
        text = text.replace(c + MARK, c)
    parts = text[1:].split(MARK)
    if len(parts) > 1 and not parts[-1].strip(cut):
        parts[-2:] = [parts[-2] + parts[-1]]
    return parts


def _segments_by_rule(text: str, cut: str) -> list[str]:
    kind = re.escape(cut)
    found = re.findall(rf"[{kind}]*[^{kind}]+(?:[{kind}]+\Z)?|[{kind}]+\Z", f" {text}")
    if re.search(rf"[^\S{kind}]|[\u180e\u200b\x1c-\x1f\x85]", text) is None:
        return found
    # white space that is not cut before: what follows it goes on in the same run, so it stays in the same segment
    out: list[str] = []
    for part in found:
        if out and (out[-1][-1].isspace() or out[-1][-1] in "\u180e\u200b\x1c\x1d\x1e\x1f\x85"):
            out[-1] += part
        else:
            out.append(part)
    return out


def _numbered(block_chars: int):
    """Adds block, for texts that follow one another, of about so many characters together, and pos, their order there."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, pos = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, order = array("q"), array("i")
            for n in pa.compute.utf8_length(batch["text"]).to_pylist():
                if size and size + n > block_chars:
                    block, size, pos = block + 1, 0, 0
                size, pos = size + n, pos + 1
                blocks.append(block)
                order.append(pos)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(order, pa.int32())], names=[*batch.schema.names, "block", "pos"])

    return run


def _counted(cut: str):
    """(block, first, place, segment, n): the distinct segments of the texts of a block from place `first` on, in the order in which they first stand there, and how often they do."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, found = None, 0, Counter()

        def told() -> Iterator[pa.RecordBatch]:
            if found:
                n = len(found)
                columns = [pa.array([block] * n, pa.int64()), pa.array([first] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "first", "place", "segment", "n"])

        for batch in batches:
            for own, pos, text in zip(batch["block"].to_pylist(), batch["pos"].to_pylist(), batch["text"], strict=True):
                if own != block:
                    yield from told()
                    block, first, found = own, pos, Counter()
                if text := text.as_py():
                    found.update(segments_of(text, cut))
        yield from told()

    return run


def _tokenised(paths: tuple[str, str]):
    """Rows sorted by segment: every segment is tokenised by both and aligned once, but for one that goes on in the next batch."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(*paths)
        written_as = [str(i) for i in range(1 + max(*both.bytes_a, len(both.bytes_b)))]
        for batch in batches:
            coded = batch["segment"].dictionary_encode()
            codes, links = zip(*((_told(code, written_as), pairs) for code, pairs in both.align(coded.dictionary.to_pylist())), strict=True)
            columns = [pa.array(c, pa.binary()).take(coded.indices) for c in (codes, links)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("block", "first", "place", "n")), *columns], names=["block", "first", "place", "n", "code", "links"])

    return run


def _in_runs(docs: pa.Table, firsts: set[int]) -> Iterator[tuple[int, list[int]]]:
    """The rows of a block's texts in order, in the runs that were counted together."""
    pos = docs["pos"].to_numpy()
    order = np.argsort(pos, kind="stable")
    starts = np.array(sorted(firsts | {int(pos.min())}))
    of = np.searchsorted(starts, pos[order], side="right") - 1
    for n, first in enumerate(starts.tolist()):
        yield first, order[of == n].tolist()


def _places(texts: pa.ChunkedArray, rows: list[int], cut: str) -> Iterator[tuple[int, list[int]]]:
    """For each text of a run the places of its segments, numbered as `_counted` does."""
    place: dict[str, int] = defaultdict(itertools.count().__next__)
    for row in rows:
        text = texts[row].as_py()
        yield row, list(map(place.__getitem__, segments_of(text, cut))) if text else []


def _holding(cut: str):
    """(block, first, place, less): how often segments stand in the texts of a block that hold one of its bad segments."""

    def run(docs: pa.Table, bad: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        firsts, places = bad["first"].to_pylist(), bad["place"].to_pylist()
        for first, rows in _in_runs(docs, set(firsts)):
            known, found = {p for f, p in zip(firsts, places, strict=True) if f == first}, Counter()
            for _, own in _places(docs["text"], rows, cut):
                if not known.isdisjoint(own):
                    found.update(own)
            out += [(first, p, n) for p, n in found.items()]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array([bad["block"][0].as_py()] * len(out), pa.int64()), *map(pa.array, columns, kinds)], names=["block", "first", "place", "less"])

    return run


def _links_of(batch: pa.RecordBatch, ids: str) -> tuple[np.ndarray, np.ndarray]:
    """The links of all rows as numbers, A's id before B's, and how many each row has."""
    data = batch["links"].fill_null(b"")
    pairs = np.frombuffer(b"".join(data.to_pylist()), np.dtype(ids)).reshape(-1, 2).astype(np.int64)
    return (pairs[:, 0] << 32) | pairs[:, 1], np.asarray(pa.compute.binary_length(data), np.int64) // (2 * np.dtype(ids).itemsize)


def _paired(ids: str):
    """(pair, count) of the links of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, sizes = _links_of(batch, ids)
            distinct, of = np.unique(pairs, return_inverse=True)
            counts = np.bincount(of, np.repeat(np.asarray(batch["n"]), sizes), len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(counts)], names=["pair", "count"])

    return run


def _rated(known: Broadcast, ids: str):
    """Adds to n_best and count_sum what the known pairs give."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            asked, sizes = _links_of(batch, ids)
            at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
            hit = pairs[at] == asked
            ends = np.cumsum(sizes)
            sums = [np.r_[0, np.cumsum(v)] for v in ((hit & best[at]).astype(np.int64), np.where(hit, counts[at], 0))]
            added = [pa.array(np.asarray(batch[c]) + s[ends] - s[ends - sizes]) for c, s in zip(("n_best", "count_sum"), sums, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names=batch.schema.names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many rows of a block as one, so that their shuffle carries little besides the codes."""
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        block, first, place, best, sums = (table[c].to_numpy() for c in ("block", "first", "place", "n_best", "count_sum"))
        codes = table["code"].to_pylist()
        order = np.lexsort((first, block))
        cuts = np.flatnonzero(np.r_[True, (np.diff(block[order]) != 0) | (np.diff(first[order]) != 0)])
        for rows in np.split(order, cuts[1:]):
            own = [codes[i] or bytes(HEAD_BYTES) for i in rows.tolist()]
            groups = b"\n".join([c[HEAD_BYTES :] for c in own])
            data = [place[rows].astype("<i4").tobytes(), b"".join([c[: HEAD_BYTES] for c in own]), len(groups), pa.compress(groups, "zstd", asbytes=True), best[rows].astype("<i4").tobytes(), sums[rows].astype("<i8").tobytes()]
            columns = [pa.array([block[rows[0]]], pa.int64()), pa.array([first[rows[0]]], pa.int32()), *(pa.array([d], pa.int64() if isinstance(d, int) else pa.binary()) for d in data)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED_COLUMNS.split(", ")])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED_ROWS:
            yield from told()
            held, size = [], 0
    if size:
        yield from told()


def _composed(cut: str):
    """The documents of a block, put together of its segments."""

    def composed(docs: pa.Table, packed: pa.Table) -> pa.Table:
        firsts = packed["first"].to_pylist()
        rows_of, sums, chunks = [], [], []
        for first, rows in _in_runs(docs, set(firsts)):
            mine = [i for i, f in enumerate(firsts) if f == first]
            place, told, best, sum_ = (np.concatenate([np.frombuffer(packed[c][i].as_buffer(), kind) for i in mine] or [np.zeros(0, kind)]) for c, kind in (("places", "<i4"), ("numbers", "<i4"), ("best", "<i4"), ("sums", "<i8")))
            numbers, groups, whole = np.zeros((len(place), len(NUMBERS)), np.int64), [""] * len(place), np.zeros(len(place), bool)
            told = told.reshape(-1, 3)
            numbers[place, :3], numbers[place, 4], numbers[place, 5], whole[place] = told, best, sum_, told[:, 2] > 0
            numbers[:, 3] = numbers[:, 0] + numbers[:, 1] - numbers[:, 2]
            at = iter(place.tolist())
            for i in mine:
                text = pa.decompress(packed["groups"][i].as_buffer(), packed["length"][i].as_py(), "zstd", asbytes=True).decode()
                for string in text.split("\n"):
                    groups[next(at)] = string
            complete, strings = whole.all(), []
            for row, of in _places(docs["text"], rows, cut):
                total, string = np.zeros(len(NUMBERS), np.int64), ""
                if of and (complete or whole[of].all()):
                    total, string = numbers[np.array(of, np.int32)].sum(axis=0), ";".join(map(groups.__getitem__, of))
                rows_of.append(row)
                sums.append(total)
                strings.append(string)
                if len(strings) == 200:
                    chunks.append(pa.array(strings, pa.string()))
                    strings = []
            chunks.append(pa.array(strings, pa.string()))
        columns = [docs["doc_id"].take(pa.array(rows_of)), *map(pa.array, np.array(sums).T), pa.chunked_array(chunks)]
        return pa.table(columns, names=["doc_id", *NUMBERS, "groups"])

    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        try:
            return composed(docs, packed)
        finally:
            give_back()

    return run


def aligned_segments(documents: DataFrame, paths: tuple[str, str], cut: str, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """The documents in blocks (doc_id, text, block, pos), and the distinct segments of each block with their alignment (block, first, place, n, code, links).

    n of a segment counts its places in the block's documents that have tokens at all: where a segment's tokens do
    not give back its bytes, the documents that hold it are found and what stands in them is subtracted.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = written(docs.mapInArrow(_numbered(block_chars), "doc_id long, text string, block long, pos int"), "blocks", "zstd")
    parts = docs.select("block", "pos", "text").mapInArrow(_counted(cut), "block long, first int, place int, segment string, n long")
    aligned = written(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_tokenised(paths), ALIGNED_COLUMNS), "aligned", "zstd")
    bad = aligned.where("code is null").select("block", "first", "place")
    if not bad.isEmpty():
        hit = docs.join(bad.select("block"), "block", "left_semi").select("block", "pos", "text")
        less = hit.groupBy("block").cogroup(bad.groupBy("block")).applyInArrow(_holding(cut), "block long, first int, place int, less long")
        counted = aligned.join(less, ["block", "first", "place"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
        aligned = written(counted.select(*aligned.columns), "counted")
    return docs, aligned


def link_counts(aligned: DataFrame, ids: str) -> DataFrame:
    """(a, b, count, best) of the linked pairs of ids: how many links of the corpus hold the pair, and whether none of its b is held by more."""
    pairs = aligned.select("n", "links").mapInArrow(_paired(ids), "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count")).where(F.col("count") > 0)
    pairs = written(pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "count"), "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    # a row for each id of B: as many as its vocabulary has, whatever the corpus
    return pairs.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _with_rating(aligned: DataFrame, pairs: DataFrame, ids: str, part_pairs: int) -> DataFrame:
    """Adds n_best and count_sum. The pairs, which the vocabularies bound, go to the tasks in parts of about `part_pairs`, one pass over the segments each."""
    spark = aligned.sparkSession
    rated = aligned.select("block", "first", "place", "code", "links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    parts = max(1, -(-pairs.count() // part_pairs))
    for part in range(parts):
        mine = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part).select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("pair"), "count", "best").toPandas().sort_values("pair")
        if len(mine):
            known = spark.sparkContext.broadcast((mine["pair"].to_numpy(np.int64), mine["count"].to_numpy(np.int64), mine["best"].to_numpy(bool)))
            rated = rated.mapInArrow(_rated(known, ids), rated.schema)
            if parts > 1:
                rated = written(rated, f"rated-{part}")
    return rated.drop("links")


def align_documents(documents: DataFrame, paths: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS, part_pairs: int = PART_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document.

    A tokenises a blank and the text, B the text, before which it puts a blank itself. `groups` holds the ids of A and B
    between places where tokens of both end, as `a1,a2|b1;a3|b2,b3`. Links are all pairs of places of
    tokens whose bytes overlap; count_sum adds up, over a document's links, how many links of the corpus
    hold the same pair of ids, n_best counts the links whose pair no other pair of its id of B surpasses.

    Texts are cut before runs of white space, where A's own rule ends tokens and no piece of B goes on with white
    space behind other signs (checked against the vocabulary; white space that fails the check is not cut before).
    A block of some 12 million characters sends on each of its distinct segments once; the blocks' equal segments
    meet in one task and are tokenised once; a block's segments join its texts again.

    A text that is null or empty, or that the tokens of A or B do not give back byte for byte (B writes
    U+2581 as a blank), has no tokens: zeros and empty groups, and its links count nowhere. Repeated rows
    count each for itself and give a row each, null ids too; an empty table gives no rows; other columns are not read.
    """
    paths = paths or tokenizer_paths()
    small_batches(documents.sparkSession)
    both = Tokenizers(*paths)
    docs, aligned = aligned_segments(documents, paths, both.cut, block_chars)
    rated = _with_rating(aligned, link_counts(aligned, both.ids), both.ids, part_pairs)
    packed = rated.mapInArrow(_packed, PACKED_COLUMNS)
    return docs.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(_composed(both.cut), DOCUMENT_COLUMNS)


def alignment_digest(rows: DataFrame) -> DataFrame:
    """The rows of the query: groups as their SHA-256, none for documents without tokens."""
    return rows.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
