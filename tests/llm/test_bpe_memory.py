"""The last stage of the pipeline: a worker encodes or decodes, never both, and gets its texts in small batches."""

import hashlib

from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import op9_bpe


def test_coding_and_decoding_build_only_what_they_need():
    ranks = op9_bpe.Vocabulary.load(path("byte_bpe_50k.tiktoken"), PATTERN)
    coder, decoder = (op9_bpe.Vocabulary(*ranks.__getstate__()) for _ in range(2))
    ids = coder.ids("Zwei Wörter, two words\n")
    assert coder.table is None and decoder.coder is None
    assert decoder.text(ids).decode() == "Zwei Wörter, two words\n" and decoder.coder is None


def test_stage_sends_few_rows_at_once_and_keeps_ids(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 7 > 0, F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    most = spark.sparkContext.accumulator(0)
    plain = type(docs).mapInArrow

    def counted(df, f, *a, **b):
        def run(batches):
            for x in batches:
                most.add(x.num_rows > 256)
                yield from f(iter([x]))
        return plain(df, run, *a, **b)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    try:
        got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "5000"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert most.value == 0 and len(got) == 3000
    for i in (0, 1, 2999):
        text = f"word {i}" if i % 7 else ""
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].n_tokens * 4 == len(got[i].ids) and got[i].lang == "en"
