"""The toxicity machine on planted insults, and the pipeline's stages on a small table."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from wardline.llm import op4_contamination, op10_toxic

INSULTS = ["grumblehead", "snivelwart", "muckbrain", "dolterix"]


def planted(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["an", "the", "re", "on", "ti", "sh"]) for _ in range(r.randrange(1, 4))) for _ in range(200)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 80))]
        y = int(r.random() < 0.3)
        for _ in range(2 * y):
            w.insert(r.randrange(len(w)), r.choice(INSULTS))
        rows.append((i, " ".join(w), y))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = planted(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (rows[0][0], rows[0][2])], "doc_id long, toxic int")
    return op10_toxic.train(docs, labels)


def test_held_out_rows_and_disguises(spark, model):
    rows = planted(300, 2) + [(1000, "you g-r-umble.head and snivel-wart", 1), (1001, "a m u c k b r a i n and a d o l t e r i x", 1), (1002, "grumbleehead snivelxwart", 1), (1003, "the an reti", 0)]
    extra = [(2000, None, 0), (2001, "", 0), (2002, "... 12 \n", 0), (None, "the the", 0), (5, rows[5][1], rows[5][2]), (2003, "the re " * 20000 + "muckbrain dolterix", 1), (2004, "an" * 5000, 0)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows + extra], "doc_id long, text string, score double").repartition(3)
    got = {(str(x.doc_id), x.text): x.score for x in op10_toxic.score(df, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[(str(i), t)] >= 0.5) == y for i, t, y in rows + extra]
    assert np.mean(right) > 0.98 and all(right[len(rows) - 4 :])
    assert op10_toxic.score(df.limit(0), model).count() == 0


def test_folds_and_no_labels(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert {r[0] for r in df.where(op10_toxic.held_out()).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert op10_toxic.train(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert [x.score for x in op10_toxic.score(docs, None).collect()] == [0.0, 0.0]


def test_units_cover_whole_texts():
    letters, first, size, text = op10_toxic.units(["ab cd", "", "a b c d", "x" * 100])
    got = sorted((int(t), "".join(chr(96 + c) for c in letters[f : f + n])) for f, n, t in zip(first, size, text, strict=True))
    assert got[:2] == [(0, "ab"), (0, "cd")] and (2, "abcd") in got and sum(t == 3 for t, _ in got) == 8


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, sf))
        assert docs.columns == cols, name
        kept.append({r.doc_id for r in docs.collect()})
        assert kept[-1] <= kept[-2] and kept[-1]
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    assert op4_contamination.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == kept[-1] and all(r.n_tokens * 4 == len(r.ids) for r in out)
    spark.conf.set("spark.sql.shuffle.partitions", old)
