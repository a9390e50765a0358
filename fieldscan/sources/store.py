"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: the session's, or, in local mode only, a folder of this machine where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors would write where neither the driver nor each other can read")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldscan-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Setting that bounds the bytes of rows that a Python worker gets at a time.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def saved(df: DataFrame, compression: str | None = None, batch: str | None = None) -> DataFrame:
    """df written as Parquet under the shared folder and read again: lineage ends there, and a lost executor costs a read.
    compression is a codec other than the session's; batch bounds BATCH_BYTES meanwhile, where the session does not set it."""
    conf, path = df.sparkSession.conf, f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    bounded = batch is not None and conf.get(BATCH_BYTES, None) is None
    if bounded:
        conf.set(BATCH_BYTES, batch)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if bounded:
            conf.unset(BATCH_BYTES)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle. A written table looks small, as its files are compressed; its rows, sent whole to every task by
    way of the driver, may not fit there."""
    return df.hint("merge")
