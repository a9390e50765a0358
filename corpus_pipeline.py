"""A document pipeline: reject toxic texts, keep one of each near-duplicate group, drop documents with benchmark passages,
mask secrets, pack into sequences. Each stage is one operator applied to all that the stage before it kept.

Rows with a null doc_id cannot be linked, so the second stage drops them; the others judge them like any row. Rows that
repeat a doc_id share its fate in the second stage and are judged one by one elsewhere. Null texts are kept as they are;
empty tables give empty tables. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.llm import decontaminate, packing, secrets, simhash, toxicity
from fieldscan.llm.common import checkpoint_dir, saved, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes at this toxicity: where the logistic model takes abuse for more likely than not.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the lexicon model rejects; it learns from all labelled rows."""
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(docs, *toxicity.train(docs, labels))
    return scored.where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose id is the smallest of their component. Links are those of fingerprints by Golay keys, as op2 finds them, and those of
    texts whose shingles are compared in full, which also reach near copies whose fingerprints differ in more bits."""
    docs = docs.select(*COLUMNS).where("doc_id IS NOT NULL")
    texts = docs.select("doc_id", "text")
    found = [simhash.near_duplicates(texts), simhash.near_copies(texts)]
    links = [f.where("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")) for f in found]
    gone = saved(simhash.components(links[0].unionByName(links[1]).distinct()).where("node <> label").select(F.col("node").alias("doc_id")).distinct())
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    flagged = decontaminate.flag_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return flagged.where("_n_hit = 0").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked and n_chars counted anew where the text changed."""
    masked = secrets.redact(secrets.scan_secrets(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    pieces = packing.token_pieces(docs, packing.default_tokenizer(), with_ids=False)
    return packing.pack(pieces.drop("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_group),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot state the learned stages and the packing; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
