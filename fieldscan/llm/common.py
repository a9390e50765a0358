"""What the operators of this subpackage share: checkpoints, ASCII case folding and fold assignment."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpoint_dir, saved

__all__ = ["TEXT_BATCH", "checkpoint_dir", "fold_ascii", "held_out", "labelled_sample", "release", "saved", "share_limit", "small", "table"]

#: A table of at most this many rows of a few numbers (under about 32 MB) may be broadcast once its rows have been counted.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that a Python worker gets at a time: it holds them several times over, and what it yields.
TEXT_BATCH = "4m"
#: Rows are sampled by a hash modulo this.
SHARE = 1_000_003
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, n: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint when its counted rows, n, are within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if n <= limit else df


def release() -> None:
    """Gives memory that a task no longer needs back: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, which else keeps what lies below its last block in use
    if trim is not None:
        trim(0)


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, equals fold; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, label) of about `sample` rows of each label, 0 and 1, at most.

    labels has (doc_id, label); the choice is by a hash of doc_id, before the join, and an id counts once for each label,
    so what meets the texts is bounded by the sample and, once counted, broadcast: no other text is shuffled. A repeated
    id gives its least text. Null ids, labels and texts are left out.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    limit = F.when(F.col("label") == 1, share_limit(sample, sizes.get(1, 0))).otherwise(share_limit(sample, sizes.get(0, 0)))
    chosen = saved(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) < limit).distinct())
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(small(chosen, chosen.count()), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def share_limit(sample: int, n: int) -> int:
    """Hashes modulo SHARE below this are about `sample` of n."""
    return SHARE if n <= sample else SHARE * sample // n
