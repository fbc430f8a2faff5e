"""Two sets of rows compared by sketches: what shuffles follows what differs, not what is stored."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.scratch import staged

CELLS = 96  # a bucket of so many cells gives back about 70 differences
LEVELS = (1 << 10, 1 << 14, 1 << 18)  # numbers of buckets, tried in turn
SENT_KEYS = 1_000_000  # keys that may go to all tasks: 8 MB
PEELED = pa.schema([("bucket", pa.int64()), ("key", pa.int64())])


def _keyed(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """With two hashes of all columns (null is a value of its own), a product that shows whether a key stands alone, and a bucket."""
    def hashed(names: list[str]) -> Column:
        return F.xxhash64(*[part for c in names for part in (F.coalesce(c, F.lit("")), F.col(c).isNull())])

    rows = rows.select(*columns, hashed(columns).alias("key"), hashed(columns[::-1]).alias("other"))
    proof = F.col("key").bitwiseAND(F.lit(0x7FFFFFFF)) * F.shiftrightunsigned("key", 33)
    return rows.withColumn("proof", proof).withColumn("bucket", F.col("other").bitwiseAND(F.lit(buckets - 1)))


def _places(key, third: int, shift, low) -> list:
    """The three cells of a key, one in each third of a bucket."""
    return [low(shift(key, 20 * k)) % third + k * third for k in range(3)]


def _cells(rows: DataFrame, sign: int, cells: int) -> DataFrame:
    places = _places(F.col("key"), cells // 3, F.shiftrightunsigned, lambda c: c.bitwiseAND(F.lit(0xFFFFF)))
    return rows.select("bucket", F.explode(F.array(*places)).alias("cell"), F.lit(sign).alias("n"), "key", "other", "proof")


def _peel(cells: int):
    unsigned = (1 << 64) - 1

    def peel(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        left = {r["cell"]: [r["n"], r["key"], r["other"], r["proof"]] for r in table.to_pylist()}
        keys, todo = [], list(left)
        while todo:
            n, key, other, proof = left.get(cell := todo.pop(), (0, 0, 0, 0))
            plain = key & unsigned
            at = _places(plain, cells // 3, lambda x, by: x >> by, lambda x: x & 0xFFFFF)
            if abs(n) != 1 or proof != (plain & 0x7FFFFFFF) * (plain >> 33) or cell not in at:
                continue
            keys.append(key)
            for c in at:
                m, *sums = left.get(c, (0, 0, 0, 0))
                left[c] = [m - n, *(a ^ b for a, b in zip(sums, (key, other, proof), strict=True))]
                todo.append(c)
        # what is left over shows that there were too many differences; the bucket is then compared row by row
        found = [None] if any(any(v) for v in left.values()) else keys
        return pa.table([pa.array([bucket] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=PEELED)

    return peel


def differences(have: DataFrame, want: DataFrame, columns: tuple[str, ...] = ("path", "id"), cells: int = CELLS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(columns, have, want) of the rows that stand in one of two sets only, by invertible Bloom lookup tables.

    Rows are keys: one that is repeated counts once, or, where a side has it an even number of times more, is found by the
    comparison of its bucket. Each task folds its rows into cells (a count and xors of hashes) and these alone
    are shuffled and subtracted. A bucket whose cells can be undone gives the keys that differ; of the others all
    rows are compared, so the result is whole, whatever differs. If more than half fail, more buckets are tried.
    Both sides are read once a level and once for the rows of the keys; pass staged rows. The columns are strings.
    """
    names = list(columns)
    for buckets in levels:
        both = [_keyed(side, names, buckets) for side in (have, want)]
        sums = _cells(both[0], 1, cells).unionByName(_cells(both[1], -1, cells)).groupBy("bucket", "cell").agg(F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in ("key", "other", "proof")])
        sums = sums.where("n <> 0 or key <> 0 or other <> 0 or proof <> 0")
        peeled = staged(sums.groupBy("bucket").applyInArrow(_peel(cells), "bucket long, key long"), "peeled")
        found, failed = peeled.agg(F.count("key"), F.count_if(F.col("key").isNull())).first()
        if failed <= buckets // 2:
            break
    rows = both[0].select(*names, "key", "bucket", F.lit(True).alias("have")).unionByName(both[1].select(*names, "key", "bucket", F.lit(False).alias("have")))
    keys, rest = peeled.select("key").where("key is not null"), peeled.where("key is null").select("bucket")
    named = rows.join(F.broadcast(keys) if found <= SENT_KEYS else keys, "key", "left_semi")
    # at most one number a bucket: 2 MB
    others = rows.join(F.broadcast(rest), "bucket", "left_semi") if failed else named.limit(0)
    sides = named.unionByName(others.select(named.columns)).groupBy(*names).agg(F.bool_or("have").alias("have"), F.bool_or(~F.col("have")).alias("want"))
    return sides.where(F.col("have") != F.col("want"))
