"""From raw documents to tokens: toxic texts go, then exact copies, near copies and documents that hold benchmark items; what stays is encoded.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``. A row that no stage objects
to arrives at the end once. What a stage does with nulls, ties and repeated rows is told by its operator."""

from __future__ import annotations

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import op1_exact, op4_contamination, op5_near, op9_bpe, op10_toxic
from wardline.llm.common import arrow_rows, keep, store

#: texts that travel to a worker of the last stage at once
ROWS = 256


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the machine is trained on those labelled rows that are not held out."""
    model = op10_toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op10_toxic.score(docs, model, out="_score").where("_score < 0.5").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return op1_exact.unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on shingles of five words, the one with the smallest doc_id stays."""
    return op5_near.unique(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of the shingles of a benchmark item go."""
    return op4_contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) in place of the texts, with the digest of what they decode to. Ids are a table before they are
    decoded: in one stage every task would have a worker that encodes and one that decodes, and batches of both in memory. Both run here, a
    few hundred rows at a time."""
    vocabulary = op9_bpe.Vocabulary.load(path("byte_bpe_50k.tiktoken"), PATTERN)
    with arrow_rows(spark, ROWS):
        coded = store(op9_bpe.encode(docs, vocabulary), compression="zstd")
        out = op9_bpe.decode(coded, vocabulary, "ids", "_bytes", keep_ids=True).withColumn("decoded_sha256", F.sha2("_bytes", 256))
        return store(out.drop("_bytes"), compression="zstd")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", encode)]
#: the first stage is a trained machine, so there is no SQL for the whole
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is kept in the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
