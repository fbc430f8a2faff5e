import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import packing, sharding


def test_histogram_schedule_equals_one_heap():
    import heapq
    import random

    rng = random.Random(3)
    for _ in range(30):
        classes = {rng.randint(1, 500): rng.randint(1, 400) for _ in range(rng.randint(1, 12))}
        plan = sharding.longest_first([(s, n, s * n) for s, n in classes.items()], 7)
        load = np.zeros(7)
        for size, starts, shards in plan:
            ends = [*starts[1:], classes[size]]
            for a, b, s in zip(starts, ends, shards, strict=True):
                load[s] += size * (b - a)
        heap = [0.0] * 7
        for size in sorted(classes, reverse=True):
            for _ in range(classes[size]):
                heapq.heapreplace(heap, heap[0] + size)
        assert sorted(load) == sorted(heap)


def test_shards(sf):
    docs = sf[1]("documents")
    rows = sharding.shard_documents(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    load, slots, where = defaultdict(int), defaultdict(list), {}
    for r in rows:
        assert r["size"] == len(r["text"].encode()) + 8 and r["text_crc32"] == zlib.crc32(r["text"].encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert where.setdefault(r["text"], r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_shards_and_a_hot_group(make):
    docs = make([(i, "x" * (i % 700)) for i in range(5000)] + [(9000 + i, "hot") for i in range(2500)])
    rows = sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = sorted(r["b"] for r in rows)
    assert len(b) == 24 and b[-1] - b[0] < 0.02 * b[0] and len({r["shard"] for r in sharding.shard_documents(docs).where("doc_id >= 9000").collect()}) == 1


def test_odd_shards(odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 11 and len({(r["shard"], r["slot"]) for r in rows}) == 11
    assert sharding.shard_documents(odd.limit(0)).count() == 0


# Packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_path())
    return [[*encode.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def checked(docs, capacity):
    """Checks every promise of a packing; gives the number of sequences and of tokens."""
    rows = packing.pack_documents(docs, capacity=capacity).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = dict(zip(texts, whole_ids(texts.values()), strict=True))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, own in pieces.items():
        own.sort()
        assert [p[0] for p in own] == list(range(len(own))) and sum(p[2] for p in own) == len(ids[doc])
        assert all(p[2] == capacity for p in own[:-1])
    assert set(pieces) == set(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(map(len, ids.values()))


def test_packing_round_trip(sf, make, words):
    sequences, tokens = checked(sf[1]("documents"), 4096)
    assert sequences <= np.ceil(tokens / 4096) + 3
    sequences, tokens = checked(make([(i, " ".join(words(1 + i % 90))) for i in range(700)] + [(10_000, None), (10_001, ""), (10_002, "'s <|endoftext|> ÀÉ x y\x1cz İ ΑΣ ΑΣ. 3.14 don't\r\n\tend")]), 256)
    assert sequences <= 1.02 * tokens / 256 + 2


def test_pieces_for_odd_rows(odd):
    rows = packing.pack_documents(odd).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["length"] == 1 for r in rows if r["doc_id"] in (1, 2, 3, 9)) == 4
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_configurations_fill_and_cover():
    sizes, values = np.array([300, 700, 1100]), np.array([3.0, 7.5, 11.0])
    counts = packing.best_configuration(sizes, values, 4096)
    best = max(a * 3.0 + b * 7.5 + c * 11.0 for a in range(14) for b in range(6) for c in range(4) if a * 300 + b * 700 + c * 1100 <= 4096)
    assert counts @ sizes <= 4096 and counts @ values == best
    demand = np.array([100.0, 50.0, 30.0])
    program = packing.configuration_program(sizes, demand, 4096)
    assert (sum(c * x for c, x in program) >= demand - 1e-6).all()
    assert sum(x for _, x in program) <= 1.1 * (sizes @ demand) / 4096


def test_histograms_pack_close_to_their_bound():
    rng = np.random.default_rng(1)
    for spread in (1.0, 0.4):
        lengths = np.minimum(np.exp(rng.normal(6.2, spread, 20_000)).astype(int) + 1, 4096)
        table = packing.pack_histogram(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True)))
        filled = {}
        for r in table.itertuples():
            assert (r.hi - r.lo) % r.copies == 0
        sequences = max(r.first + (r.hi - r.lo) // r.copies for r in table.itertuples())
        assert sequences <= 1.01 * lengths.sum() / 4096 + 1, (sequences, lengths.sum() / 4096, filled)
