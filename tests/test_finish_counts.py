"""The finish_batch query counts refused questions like all others."""

from pyspark.sql import functions as F

from test_answer import ASKED, done  # noqa: F401
from wardline.plans import queries


def test_failed_rows_are_counted(spark, done, monkeypatch):  # noqa: F811
    q = spark.createDataFrame([(i, u, t) for i, (u, t) in ASKED.items()], "question_id int, user_email string, question string")
    monkeypatch.setattr(queries, "_sources", lambda *_: done[1])
    monkeypatch.setattr(queries.B, "questions", lambda *_: q)
    got = queries.finish_batch(spark, "").groupBy("status").agg(F.sum("questions").alias("n")).collect()
    n = {r.status: r.n for r in got}
    assert sum(n.values()) == len(ASKED) and n["failed"] == 1
