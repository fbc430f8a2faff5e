"""Near duplicates by BagMinHash: signatures of weighted word shingles, bands, and the exact overlap of multisets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, cut_narrow, cut_thin, in_sample, releasing, sample_share, whole_text, with_maybe, with_text_columns

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 24
SMALL = 8
GROUP = 500
BEST = 5
LIKELY = 0.65  # share of equal signature parts under which a pair waits for the last round: four deviations below SIMILARITY
LEAST_BITS, MOST_BITS = 256, 1 << 14  # of a sketch
BLOCK = 500  # nodes of a block of the last round
WIDE = 10_000  # nodes of a bucket up to which blocks meet; the members of wider ones are joined by their rarest shingles
HOT = 2_000  # pairs of one node, or holders of one token, that meet in one place
SLOTS = 1 << 20
COUNTED = 50_000  # nodes whose tokens are counted for the order of the exact join; any order gives the same pairs
BLOCK_BYTES = 500_000
BATCH_ROWS = 500
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
PLACES = mix(np.arange(101, 101 + WORDS, dtype=np.uint64) * BASE) | np.uint64(1)


class _Powers:
    """Powers of the hash's base and of its inverse, kept from one block to the next."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE_INVERSE)], dtype=np.uint64)
        return self.up, self.down


def shingles(texts: list[str], powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of `WORDS` words; a shorter text that has words gives one shingle of them all."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    bounds = np.cumsum([len(c) + 1 for c in coded])
    blank = BLANK[data]
    edge = np.diff(np.r_[True, blank].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers.of(len(data))
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64)]
        word = mix((prefix[end] - prefix[start]) * down[start])
        doc = np.searchsorted(bounds, start, side="right")
        counts = np.bincount(doc, minlength=len(texts))
        full = np.zeros(0, np.uint64)
        of = np.zeros(0, np.int64)
        if len(word) >= WORDS:
            inside = doc[WORDS - 1 :] == doc[: len(doc) - WORDS + 1]
            total = sum((word[k : len(word) - WORDS + 1 + k] * PLACES[k] for k in range(1, WORDS)), word[: len(word) - WORDS + 1] * PLACES[0])
            full, of = mix(total[inside]), doc[: len(doc) - WORDS + 1][inside]
        short = (counts > 0) & (counts < WORDS)
        if short.any():
            mine = np.flatnonzero(short[doc])
            first = np.r_[0, np.cumsum(counts)[:-1]]
            place = mine - first[doc[mine]]
            starts = np.flatnonzero(np.r_[True, doc[mine][1:] != doc[mine][:-1]])
            whole = mix(np.add.reduceat(word[mine] * PLACES[place], starts) + counts[short].astype(np.uint64))
            full, of = np.r_[full, whole], np.r_[of, np.flatnonzero(short)]
    return of, full


def signatures(of: np.ndarray, hashes: np.ndarray, documents: int, parts: int) -> np.ndarray:
    """BagMinHash signatures (documents, parts) of the multisets of hashes; infinite for empty ones.

    The weight of a shingle is how often it stands in the document. Weights lie on the levels (0, 1],
    (1, 2], (2, 4], (4, 8], ...: each level of each shingle is a Poisson process of its own whose rate is
    the level's width; a point at time t has a height inside the level and counts where the weight reaches
    it. A point falls on one part of the signature, which keeps the least time. A process ends once its
    time exceeds all parts. Two parts agree with the probability of the weighted Jaccard similarity.
    """
    signature = np.full(documents * parts, np.inf)
    if not len(of):
        return signature.reshape(documents, parts)
    with np.errstate(over="ignore"):
        key = mix(hashes + of.astype(np.uint64) * BASE)
    _, first, weight = np.unique(key, return_index=True, return_counts=True)
    doc, item = of[first], hashes[first]
    rows = [(doc, item, weight, np.zeros(len(doc)), np.ones(len(doc)), np.uint64(0))]
    low, level = 1, 1
    while (more := weight > low).any():
        rows.append((doc[more], item[more], weight[more], np.full(more.sum(), float(low)), np.full(more.sum(), float(low)), np.uint64(level)))
        low, level = low * 2, level + 1
    with np.errstate(over="ignore"):
        state = np.concatenate([mix(r[1] + r[5] * np.uint64(0xD1B54A32D192ED03)) for r in rows])
    doc, weight, low_, width = (np.concatenate([r[i] for r in rows]) for i in (0, 2, 3, 4))
    time = np.zeros(len(doc))
    made, points = 0, 1
    while len(doc):
        with np.errstate(over="ignore"):
            step = np.arange(made + 1, made + points + 1, dtype=np.uint64) * BASE
            u = mix(state[:, None] + step[None, :])
            v = mix(u ^ np.uint64(0xA0761D6478BD642F))
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width[:, None]
        times = np.cumsum(np.concatenate([time[:, None], gap], axis=1), axis=1)[:, 1:]
        part = ((v >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        height = low_[:, None] + np.floor((v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[:, None])
        counts = height < weight[:, None]
        at = (doc[:, None] * parts + part)[counts]
        np.minimum.at(signature, at, times[counts])
        time = times[:, -1]
        last = signature.reshape(documents, parts).max(axis=1)
        alive = time <= last[doc]
        doc, weight, low_, width, state, time = (x[alive] for x in (doc, weight, low_, width, state, time))
        made += points
        points = min(made, 64)
    return signature.reshape(documents, parts)


def _blocks(texts: list[str]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def tokens(bag: np.ndarray) -> np.ndarray:
    """The sorted multiset as a set: the first, second, ... of equal hashes are different tokens."""
    place = np.arange(len(bag))
    first = np.maximum.accumulate(np.where(np.r_[True, bag[1:] != bag[:-1]][: len(bag)], place, 0))
    with np.errstate(over="ignore"):
        return mix(bag + (place - first).astype(np.uint64) * BASE)


def sketch(own: np.ndarray) -> np.ndarray:
    """Bits of a set of tokens: every token flips one. A power of two of them, some four a token; halves laid over one another give the shorter sketch.

    Where two sets differ in d tokens, their sketches differ in d bits at most; so sketches that differ in
    more bits than two similar sets may differ in tokens tell a pair apart for certain.
    """
    bits = min(max(1 << int(4 * len(own)).bit_length() - 1, LEAST_BITS), MOST_BITS) if len(own) else LEAST_BITS
    flips = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows, words) at `words` words each."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _signed():
    """For each text its bands (hashes of `ROWS` parts) and eight bits of every part; none without words."""
    powers = _Powers()

    def compute(texts: list[str]) -> dict[str, list]:
        out: list[list[int] | None] = []
        brief: list[bytes | None] = []
        for block in _blocks(texts):
            distinct = {t: i for i, t in enumerate(dict.fromkeys(block))}
            of, hashes = shingles(list(distinct), powers)
            parts = signatures(of, hashes, len(distinct), ROWS * BANDS)
            full = np.isfinite(parts[:, 0])
            bits = np.where(np.isfinite(parts), parts, 0).view(np.uint64).reshape(len(parts), BANDS, ROWS)
            with np.errstate(over="ignore"):
                band = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * BASE
                for k in range(ROWS):
                    band = mix(band + mix(bits[:, :, k] + np.uint64(k)))
            lists = band.view(np.int64).tolist()
            out += [lists[distinct[t]] if full[distinct[t]] else None for t in block]
            bytes_ = (mix(bits.reshape(len(parts), -1)) >> np.uint64(56)).astype(np.uint8)
            brief += [bytes_[distinct[t]].tobytes() if full[distinct[t]] else None for t in block]
        return {"bands": out, "sig": brief}

    return compute


def _multisets():
    """For each text its shingles' hashes, sorted, as bytes."""
    powers = _Powers()

    def compute(texts: list[str]) -> dict[str, list]:
        out = []
        for block in _blocks(texts):
            of, hashes = shingles(block, powers)
            order = np.lexsort((hashes, of))
            cuts = np.searchsorted(of[order], np.arange(len(block) + 1))
            ordered = hashes[order]
            out += [ordered[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"bag": out}

    return compute


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted multisets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    same = int(np.minimum(n[i], m[j]).sum())
    return same / (len(x) + len(y) - same)


def _compared(least: float):
    @releasing
    def run(batches):
        for batch in batches:
            a, b = batch["bag_a"], batch["bag_b"]
            good = [overlap(x.as_py(), y.as_py()) >= least for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _buckets(texts: DataFrame) -> DataFrame:
    """(node, bucket): a row for each band of each node of `texts` (node, bands)."""
    return texts.select("node", F.explode("bands").alias("bucket"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def first_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: every node with the least node of each of its buckets, for `texts` (node, bands).

    A group that shares its buckets shares their least node, so most of its pairs fall together.
    """
    rows = _buckets(texts)
    heads = rows.groupBy("bucket").agg(F.min("node").alias("other"), F.max("node").alias("last")).where("other < last").select("bucket", "other")
    return _ordered(rows.join(heads, "bucket").where("node <> other"))


def _likeliest(table: pa.Table) -> pa.Table:
    """Of the nodes of one group each with the `BEST` nodes of other labels whose signatures agree most with its own."""
    node, label = table["node"].to_numpy(), table["label"].to_numpy()
    signature = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
    found = []
    for first in range(0, len(node), 64):
        equal = (signature[first : first + 64, None, :] == signature[None, :, :]).mean(axis=2)
        equal[label[first : first + 64, None] == label[None, :]] = 0
        k = min(BEST, len(node))
        best = np.argpartition(-equal, k - 1, axis=1)[:, :k]
        row, column = np.nonzero(np.take_along_axis(equal, best, axis=1) >= LIKELY)
        found.append(np.stack([node[first + row], node[best[row, column]]]))
    pairs = np.concatenate(found, axis=1)
    return pa.table({"node": pairs[0], "other": pairs[1]})


def further_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes that share a bucket but, so far, no component: for `texts` (node, bands, sig) and `labels` (node, label).

    Only buckets with nodes of several components are looked at. In those of up to `SMALL` nodes all of
    other components meet. Larger ones fall into groups of about `GROUP` nodes, whatever their size, other
    groups in every band; there each node meets the `BEST` nodes most like it. So the pairs grow in
    proportion to the rows.
    """
    rows = _buckets(texts).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("bucket", "n")
    members = rows.join(heads, "bucket")
    window = Window.partitionBy("bucket").orderBy("node")
    near = [F.lag(F.struct("node", "label"), k).over(window) for k in range(1, SMALL)]
    small = members.where(F.col("n") <= SMALL).select("node", "label", F.array(*near).alias("met"))
    news = F.transform(F.filter("met", lambda x: x.isNotNull() & (x["label"] != F.col("label"))), lambda x: x["node"])
    large = members.where(F.col("n") > SMALL).withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / GROUP)))
    grouped = large.join(texts.select("node", "sig"), "node").select("node", "label", "sig", "bucket", "part").groupBy("bucket", "part")
    return _ordered(small.select("node", F.explode(news).alias("other")).union(grouped.applyInArrow(_likeliest, "node long, other long")))


def open_buckets(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, bucket, n) of the buckets of more than `SMALL` nodes that still hold several components; in smaller ones all have met."""
    rows = _buckets(texts).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("m")).where((F.col("l") < F.col("m")) & (F.col("n") > SMALL))
    return rows.join(heads.select("bucket", "n"), "bucket").select("node", "label", "bucket", "n")


@releasing
def _sketched(batches):
    for batch in batches:
        own = [_tokens_of(bag) for bag in batch["bag"]]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([len(x) for x in own], pa.int32()), pa.array([sketch(x).tobytes() for x in own], pa.binary())], names=["node", "size", "sketch"])


def _near_in_blocks(least: float):
    """Pairs of different labels of one block, or of two blocks of one bucket, whose sizes and sketches allow the similarity."""
    most_apart = (1 - least) / (1 + least)  # of both sizes, for sets that overlap by `least`

    def run(table: pa.Table) -> pa.Table:
        node, label, size, block = (table[c].to_numpy() for c in ("node", "label", "size", "block"))
        bits = [np.frombuffer(x, np.uint64) for x in table["sketch"].to_pylist()]
        words = np.array([len(x) for x in bits])
        left, right = block == block.min(), block == block.max()
        found = [np.zeros((2, 0), np.int64)]
        for wide in np.unique(words[left]):
            for other in np.unique(words[right]):
                x, y = np.flatnonzero(left & (words == wide)), np.flatnonzero(right & (words == other))
                w = min(wide, other)
                a, b = folded(np.stack([bits[i] for i in x]), w), folded(np.stack([bits[i] for i in y]), w)
                for first in range(0, len(x), 32):
                    i = x[first : first + 32]
                    apart = np.zeros((len(i), len(y)), np.int32)
                    for k in range(w):
                        apart += np.bitwise_count(a[first : first + 32, k, None] ^ b[None, :, k])
                    both = size[i, None] + size[None, y]
                    near = np.minimum(size[i, None], size[None, y]) >= np.maximum(size[i, None], size[None, y]) * least - 1e-6
                    p, q = np.nonzero((apart <= both * most_apart + 1e-6) & near & (label[i, None] != label[None, y]))
                    found.append(np.stack([node[i[p]], node[y[q]]]))
        pairs = np.concatenate(found, axis=1)
        return pa.table({"node": pairs[0], "other": pairs[1]})

    return run


def block_pairs(members: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of different labels in the buckets of `members` that may overlap by `least`, for `bags` (node, bag).

    The nodes of a bucket fall into blocks of about `BLOCK`; each block meets itself and every other one in
    a task of its own, so no task holds more than two.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.join(bags.mapInArrow(_sketched, "node long, size int, sketch binary"), "node")
    rows = rows.select("node", "label", "bucket", "size", "sketch", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return _ordered(rows.groupBy("bucket", "i", "j").applyInArrow(_near_in_blocks(least), "node long, other long"))


def _tokens_of(bag: pa.BinaryScalar) -> np.ndarray:
    return tokens(np.frombuffer(bag.as_py(), np.uint64))


def _slot_counts(batches):
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for bag in batch["bag"]:
            np.add.at(counts, (_tokens_of(bag) % np.uint64(SLOTS)).astype(np.int64), 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])


def _prefixes(counts: np.ndarray, least: float):
    """For each node its rarest tokens with their places, as many as may stand before the first that it shares with a text alike by `least`."""

    def run(batches):
        for batch in batches:
            bags = [_tokens_of(bag) for bag in batch["bag"]]
            found, places = [], []
            for own in bags:
                order = np.lexsort((own, counts[(own % np.uint64(SLOTS)).astype(np.int64)]))
                found.append(own[order[: int(len(own) * (1 - least) + 1e-6) + 1]])
                places.append(np.arange(len(found[-1]), dtype=np.int32))
            if not bags:
                continue
            row = np.repeat(np.arange(len(bags)), [len(x) for x in found])
            size = np.array([len(x) for x in bags], np.int32)[row]
            columns = [batch["node"].take(pa.array(row)), batch["label"].take(pa.array(row)), size, np.concatenate(places), np.concatenate(found).view(np.int64)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["node", "label", "size", "place", "token"])

    return run


def exact_pairs(bags: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of different labels that may overlap by `least`, for `bags` (node, label, bag); no such pair is left out.

    Tokens are ordered by how rare they are. All that stands before the first common token of two texts
    is in one of them only, which bounds the places of that token in both; their sizes are bounded too.
    A token's holders of its commonest label meet its other holders, never one another, and the holders
    of a hot token meet in blocks.
    """
    share = sample_share(bags.count(), COUNTED)
    counted = bags.where(in_sample(F.col("node"), share, "tokens")).select("bag").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int32)  # at most SLOTS rows come to the driver
    counts[counted["slot"].to_numpy(np.int64)] = np.minimum(counted["n"].to_numpy(np.int64), 2**31 - 1)
    prefixes = cut_lineage(bags.mapInArrow(_prefixes(counts, least), "node long, label long, size int, place int, token long"), BATCH_ROWS)
    held = prefixes.groupBy("token", "label").agg(F.count("*").alias("n"))
    heads = held.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label"))["label"].alias("most"), F.count("*").alias("labels")).where("labels > 1")
    members = prefixes.join(heads.select("token", "most", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")), "token")
    few = members.where("label <> most").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("x")
    every = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    sizes = F.col("x.size") + F.col("y.size")
    alike = (F.col("x.place") + F.col("y.place")) * (1 + least) <= sizes * (1 - least) + 1e-6
    near = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * least - 1e-6
    once = (F.col("y.label") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    met = few.join(every, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.label") != F.col("y.label")) & once & near & alike)
    return _ordered(met.select(F.col("x.node").alias("node"), F.col("y.node").alias("other")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the label is the least node of its component.

    Labels spread along the edges, then every node takes the label of its label; until nothing changes.
    """
    both = cut_thin(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = cut_thin(labels)
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(spread.select(F.col("a").alias("node"), "m"), "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        moved = cut_thin(moved)
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = cut_thin(moved.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), "old"))
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def bags_of(nodes: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, bag) of the distinct `nodes` (node); rows: (doc_id, sha, text)."""
    asked = nodes.join(texts.select("node", "doc_id", "sha"), "node")
    rows = with_maybe(rows, asked.select("sha"), "sha").where("maybe")
    # texts meet the candidates by id, which no hot text crowds; one row a node goes on
    named = asked.select("node", F.col("doc_id").alias("d"), F.col("sha").alias("s"))
    found = rows.join(named, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["sha"] == F.col("s"))).dropDuplicates(["node"])
    return cut_lineage(with_text_columns(found.select("node", "text"), _multisets, "bag binary"), BATCH_ROWS)


def compared(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs whose bags (node, bag) overlap by `least` or more. A node of many pairs meets them in several places."""
    mine = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    full = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    busy = cut_thin(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    if busy.isEmpty():
        full = full.join(mine, "a")
    else:
        parts = F.coalesce("parts", F.lit(1))
        full = full.join(busy, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
        full = full.join(mine.join(busy, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"), ["a", "part"])
    return cut_narrow(full.select("a", "b", "bag_a", "bag_b").mapInArrow(_compared(least), "a long, b long"), BATCH_ROWS)


def linked(pairs: DataFrame, texts: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts overlap by `least` or more; rows: (doc_id, sha, text)."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return compared(pairs, bags_of(asked, texts, rows), least)


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, label) after further edges (a, b): components of the labels themselves, a much smaller graph."""
    if edges.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("known"), "label")
    ends = edges
    for side in ("a", "b"):
        ends = ends.join(known, F.col(side) == F.col("known"), "left").withColumn(f"{side}_label", F.coalesce("label", side)).drop("known", "label")
    merged = components(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b"))
    new = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").withColumn("label", F.col("node"))
    both = labels.unionByName(new)
    return cut_thin(both.join(merged.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def text_sha() -> Column:
    """What tells texts apart: the 32 bytes of the SHA-256, of a null text those of the empty one."""
    return F.unhex(F.sha2(whole_text(), 256))


def classes(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per distinct text: sha, doc_id (its least), copies, label, n_links."""
    rows = documents.select("doc_id", text_sha().alias("sha"), "text")
    signed = with_text_columns(rows, _signed, "bands array<long>, sig binary")
    grouped = signed.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    texts = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()), BATCH_ROWS)
    banded = texts.where(F.col("bands").isNotNull()).select("node", "bands", "sig")
    pairs = cut_narrow(first_pairs(banded))
    edges = linked(pairs, texts, rows, least)
    labels = components(edges)
    further = cut_narrow(further_pairs(banded, labels).join(pairs, ["a", "b"], "left_anti"))
    more = linked(further, texts, rows, least)
    labels = joined_components(labels, more)
    edges = edges.union(more)
    still = cut_narrow(open_buckets(banded, labels))
    if not still.isEmpty():
        bags = bags_of(still.select("node").distinct(), texts, rows)
        rest = block_pairs(still.where(F.col("n") <= WIDE), bags, least)
        wide = still.where(F.col("n") > WIDE).select("node", "label").distinct()
        if not wide.isEmpty():
            rest = rest.union(exact_pairs(bags.join(wide, "node").select("node", "label", "bag"), least)).distinct()
        rest = cut_narrow(rest.join(pairs, ["a", "b"], "left_anti").join(further, ["a", "b"], "left_anti"))
        last = compared(rest, bags, least)
        labels = joined_components(labels, last)
        edges = edges.union(last)
    degree = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    joined = texts.select("node", "sha", "doc_id", "copies").join(labels.join(degree, "node"), "node", "left")
    return joined.select("sha", "doc_id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept.

    Documents are linked where the multisets of their five-word shingles overlap by `least` or more; a
    class is what links connect, and class_id its least doc_id, whose document is kept. n_links counts the
    links compared and found between its text and different texts. Words are what stands between white
    space, unchanged; a text of fewer than five words is one shingle. Texts without words, null ones
    among them, are near no other text; equal texts, empty ones too, are of one class. Of rows that repeat
    whole each is kept where one is; extra columns are not read; an empty table gives no rows.
    """
    found = cut_lineage(classes(documents, least))
    least_id = found.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = found.join(least_id, "label").select("sha", "class_id", "n_links")
    rows = documents.select("doc_id", text_sha().alias("sha")).join(named, "sha")
    return rows.select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class stays, that with the least doc_id, with all its columns.

    Documents that are alone in their class pass straight through; the others, and the few that a bitmap
    cannot tell from them, are joined with what stays.
    """
    found = cut_lineage(classes(documents, least))
    best = found.groupBy("label").agg(F.min(F.struct("doc_id", "sha")).alias("best"), F.sum("copies").alias("n"))
    crowded = found.join(best.where("n > 1").select("label"), "label", "left_semi").select("sha")
    rows = with_maybe(documents.select(F.struct("*").alias("row"), text_sha().alias("sha")), crowded, "sha")
    alone = rows.where(~F.col("maybe")).select("row.*")
    stays = best.select(F.col("best.sha").alias("s"), F.col("best.doc_id").alias("d"))
    met = rows.where("maybe").join(stays, (F.col("sha") == F.col("s")) & F.col("row.doc_id").eqNullSafe(F.col("d")))
    return alone.unionByName(met.dropDuplicates(["sha"]).select("row.*"))
