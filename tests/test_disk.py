"""What a table of questions leaves on the disks: no candidate but the best, no shuffle once its result is written, records in little space."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wardline import session
from wardline.operators import grounding, retrieve


def _questions(spark, n, keys):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.sample(keys, rng.randint(1, 4))), *[(True, []), (False, ["A"]), (False, ["A", "B"])][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "question_id int, question string, sees_all boolean, units array<string>")


def _chunks(spark, n, keys, ids):
    rng = random.Random(8)
    return spark.createDataFrame([(ids(i), rng.choice(["A", "B", None]), " ".join(rng.sample(keys, rng.randint(0, 5)))) for i in range(n)], "chunk_id string, unit string, content string")


KEYS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]


def test_only_the_best_candidates_are_written(spark, monkeypatch):
    cut, seen = retrieve.cut, []

    def noted(df):
        out = cut(df)
        if {"task", "chunk_id", "score"} <= set(out.columns):
            seen.append(out.groupBy("task").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(retrieve, "cut", noted)
    c = _chunks(spark, 300, KEYS, lambda i: f"c{i}").withColumn("content", F.concat("content", F.lit(" alpha")))
    assert retrieve.retrieve(_questions(spark, 60, KEYS), c, 3, hot_min=200, hot_share=0.0, hot_asks=0).count()
    assert seen and max(seen) <= 3              # every candidate of the tasks with hot keys before


@pytest.mark.parametrize(("hot", "asks"), [(40, 0), (100, 10), (0, 0), (10_000, 100)])
def test_repeated_and_missing_ids_score_as_by_key(spark, hot, asks, monkeypatch):
    q, c = _questions(spark, 60, KEYS), _chunks(spark, 200, KEYS, lambda i: f"c{i % 90}" if i % 17 else None)
    got = []
    for few in (500_000, 0):
        monkeypatch.setattr(retrieve, "BROADCAST_KEYS", few)
        got.append(sorted(map(str, retrieve.retrieve(q, c, 4, hot_min=hot, hot_share=0.0, hot_asks=asks).collect())))
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("keep", [session.cut, lambda df: session.stored(df)])
def test_shuffles_go_with_their_job(spark, keep):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    out = keep(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 7 and spark.conf.get(session._CLEANUP, None) in (None, "false", "true")


def test_matched_records_alone_are_rendered(spark):
    m = spark.createDataFrame([(1, "a", 2, 1), (1, "b", 2, 2), (2, "a", 1, 1)], "question_id int, chunk_id string, score int, rank int")
    c = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "three"), ("x", "four"), (None, "five")], "chunk_id string, content string")
    r = grounding.records_of(m, c)
    assert "LeftSemi" in r._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.question_id, x.sources, x.records) for x in r.collect()) == [(1, ["a", "b", "b"], ["one", "three", "two"]), (2, ["a"], ["one"])]
