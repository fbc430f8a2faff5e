"""A folder for files that live as long as a query needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder inside the shared `spark.checkpoint.dir`; where none is set, one of this machine, if all runs on it, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written once as Parquet and read again: what uses them several times computes them once."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
