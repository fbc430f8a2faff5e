"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

PART_ROWS = 500
BATCH_ROWS = 1_000
PLACES = 1 << 26
RANKED_ROWS = 250_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the rows of the session's Arrow batches to `rows`: rows hold whole texts here, and both sides keep whole batches in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function `run`, which at its end gives the memory that allocators keep back to the system: workers live on from task to task."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Gives the memory that allocators keep back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once in a worker process for all its tasks: functions travel by value, so what they keep themselves is gone with the task."""
    kept = sys.modules.setdefault("strandline_worker", types.ModuleType("strandline_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def with_maybe(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows with `maybe`: false only where their `column` is not among `keys` (a column of the same name). Nothing of `rows` shuffles.

    A bitmap of `PLACES` places is broadcast, a million words at most whatever the number of keys; the more
    keys, the more other rows are true as well.
    """
    place = F.pmod(F.xxhash64(column), F.lit(PLACES))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), {PLACES}L) & 63 as int))")
    bitmap = keys.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    joined = rows.join(F.broadcast(bitmap), word == F.col("_w"), "left")
    return joined.withColumn("maybe", F.coalesce(F.col("_b").bitwiseAND(bit) != 0, F.lit(False))).drop("_w", "_b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def cut_lineage(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Writes thin rows to the shared checkpoint folder, so that a lost executor costs no recomputation.

    With `batch_rows`, Python stages on the way get Arrow batches of so many rows at most: wide rows then
    take little room on both sides. The session's own setting holds again afterwards.
    """
    checkpoint_folder(df.sparkSession)
    if batch_rows is None:
        return df.checkpoint(eager=True)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(batch_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, before)


def _narrow(spark: SparkSession) -> int:
    """A sixteenth of the partitions of a shuffle; one alone would draw what it is joined with into one task."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)


def cut_narrow(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """As `cut_lineage`, for rows of a few numbers that took work to find: they go on in a sixteenth of the partitions."""
    return cut_lineage(df, batch_rows).coalesce(_narrow(df.sparkSession))


def cut_thin(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, for graphs of thin rows: few tasks make and write them, since files cost more than rows here."""
    return cut_lineage(df.coalesce(_narrow(df.sparkSession)))


def sample_share(rows: int, bound: int) -> float:
    """Share of rows to take so that about `bound` come out."""
    return min(1.0, bound / max(rows, 1))


def in_sample(key: Column, share: Column | float, salt: str) -> Column:
    """A fixed pseudo-random subset: the same rows on every run and every cluster."""
    draw = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return draw < share


def spread(keys: list[str], buckets: int) -> Column:
    """A bucket of a row by its own identity, so that rows of one hot group scatter."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def ranked(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`, a gapless rank from 0 of the rows of each `key`, without gathering a key in one task.

    Rows scatter over buckets by a hash of `order`, one for every `RANKED_ROWS` rows of `df`, 256 at least
    and 65,536 at most; a window numbers the rows inside (key, bucket), and the summed counts of the buckets
    before give the offset. Rows that tie in `order` are numbered in any order. Counts `df`: give files.
    """
    buckets = min(max(256, df.count() // RANKED_ROWS), 1 << 16)
    df = df.withColumn("_b", spread(order, buckets))
    inner = Window.partitionBy(key, "_b").orderBy(*order)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rows = df.withColumn("_r", F.row_number().over(inner))
    joined = rows.join(offsets, rows[key].eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_bb")), "left")
    return joined.withColumn(out, (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_k", "_bb", "_o", "_r")


def with_text_columns(df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, keep_text: bool = False) -> DataFrame:
    """Adds the columns of `schema`, computed from the last column of `df`, a string, which goes unless `keep_text`; the other columns pass as they are.

    `make` is called once a task and gives a function from a list of texts (null as "") to the new columns.
    """
    kept = df.schema.fields if keep_text else df.schema.fields[:-1]
    added = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in added]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        # a few rows at a time: as Python strings a whole batch takes much room
        for batch in (whole.slice(at, PART_ROWS) for whole in batches for at in range(0, whole.num_rows, PART_ROWS)):
            new = compute([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            columns = [*batch.columns[: len(kept)], *(pa.array(new[f], t) for f, t in zip(names, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(len(columns) - len(names))), *names])

    names = [f.name for f in added]
    small_batches(df.sparkSession)
    # numbers instead of names inside: names may clash with one another or with the new ones
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + list(added))
    return plain.mapInArrow(run, out).toDF(*[f.name for f in kept], *names)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes rows as Parquet into the shared checkpoint folder and reads them again: what comes after depends on files alone."""
    df.sparkSession.sparkContext.setJobDescription(f"write {name}")
    path = f"{checkpoint_folder(df.sparkSession)}/strandline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    df.sparkSession.sparkContext.setJobDescription(None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; where none is set, a folder of this machine, if all runs on it, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return context._jsc.sc().getCheckpointDir().get()
